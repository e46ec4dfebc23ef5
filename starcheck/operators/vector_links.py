"""Exact neighbourhoods of dense vectors within a cosine distance.

Vectors are put into cells around a bounded number of pivots. Angles obey the triangle
inequality, so two cells whose pivots are further apart than the search angle plus both radii
hold no pair and are never compared. The other cell pairs are multiplied block by block on the
executors. A block never gives out its pairs: it gives a neighbour count per vector, and a tree of
links that connects the same cores as all pairs would. Blocks are large and multiplied in pieces, so a
vector is sent to about as many tasks as there are cells, however many vectors there are.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.operators.skew import lookup_join
from starcheck.operators.tfidf import BATCH, INDEX, ITEM
from starcheck.session import cut

PIVOTS = 32
# Vectors of a block, at most so many numbers, and of a piece of it.
BLOCK = 32_768
BLOCK_NUMBERS = 4_000_000
PIECE = 1024
SLACK = 1e-9
CELL = [BATCH, "cell"]
BLOCK_KEY = [BATCH, "cell_a", "part_a", "cell_b", "part_b"]


def vector_items(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Equal vectors collapsed: (rows with their signature, one item per distinct vector).

    A zero vector has no direction, so it is far from everything and is left out.
    """
    keyed = vectors.filter(F.exists(column, lambda x: x != 0)).select(
        *ITEM, F.col(column).cast("array<double>").alias("signature")
    )
    items = keyed.groupBy(BATCH, "signature").agg(
        F.min(INDEX).alias(INDEX), F.count(F.lit(1)).alias("copies")
    )
    return keyed, items


def _unit_rows(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy())
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _with_cells(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the angle to it."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                cosines = _unit_rows(rows["vector"]) @ pivots.T
                rows["cell"] = cosines.argmax(axis=1)
                rows["angle"] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
                yield rows

    return items.mapInPandas(
        nearest,
        f"{BATCH} long, {INDEX} long, copies long, vector array<double>, cell long, angle double",
    )


def _blocks(spark: SparkSession, placed: DataFrame, pivots: np.ndarray, eps: float, block: int) -> DataFrame:
    """Every item once per block it takes part in, on side a, side b or both."""
    reach = math.acos(1.0 - eps)
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    gaps = spark.createDataFrame(
        pd.DataFrame(
            [(a, b, float(between[a, b])) for a in range(len(pivots)) for b in range(a, len(pivots))],
            columns=["cell_a", "cell_b", "gap"],
        )
    )
    cells = placed.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius")
    ).withColumn("parts", F.ceil(F.col("rows") / block))
    a = cells.withColumnsRenamed({n: f"{n}_a" for n in ["cell", "rows", "radius", "parts"]})
    b = cells.withColumnsRenamed({n: f"{n}_b" for n in ["cell", "rows", "radius", "parts"]})
    # At most PIVOTS cells in a batch.
    meeting = (
        a.join(b, BATCH)
        .join(F.broadcast(gaps), ["cell_a", "cell_b"])
        .filter(F.col("gap") <= reach + F.col("radius_a") + F.col("radius_b") + SLACK)
        .select(BATCH, "cell_a", "parts_a", "cell_b", "parts_b")
    )

    def numbers(count: str):
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    part = F.pmod(F.xxhash64(INDEX), F.col("_parts"))
    side_a = (
        placed.join(meeting.withColumnRenamed("cell_a", "cell"), CELL)
        .withColumn("_parts", F.col("parts_a"))
        .withColumn("part_a", part)
        .withColumn("part_b", F.explode(numbers("parts_b")))
        .withColumn("cell_a", F.col("cell"))
        .withColumn("side", F.lit("a"))
    )
    side_b = (
        placed.join(meeting.withColumnRenamed("cell_b", "cell"), CELL)
        .withColumn("_parts", F.col("parts_b"))
        .withColumn("part_b", part)
        .withColumn("part_a", F.explode(numbers("parts_a")))
        .withColumn("cell_b", F.col("cell"))
        .withColumn("side", F.lit("b"))
    )
    once = (F.col("cell_a") != F.col("cell_b")) | (F.col("part_a") <= F.col("part_b"))
    columns = [*BLOCK_KEY, INDEX, "copies", "vector", "side"]
    if "is_core" in placed.columns:
        columns.append("is_core")
    return side_a.select(*columns).unionByName(side_b.select(*columns)).filter(once)


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    a, b = (rows[rows["side"] == side].sort_values(INDEX, ignore_index=True) for side in ("a", "b"))
    return a, b


def _near_pieces(a: pd.DataFrame, b: pd.DataFrame, eps: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Which rows of the two sides of a block are neighbours, piece by piece; an item is not its own."""
    if a.empty or b.empty:
        return
    a_unit, b_unit = _unit_rows(a["vector"]), _unit_rows(b["vector"])
    a_id, b_id = a[INDEX].to_numpy(), b[INDEX].to_numpy()
    for i in range(0, len(a), PIECE):
        for j in range(0, len(b), PIECE):
            ours, theirs = slice(i, min(i + PIECE, len(a))), slice(j, min(j + PIECE, len(b)))
            near = 1.0 - a_unit[ours] @ b_unit[theirs].T <= eps
            near &= a_id[ours][:, None] != b_id[theirs][None, :]
            yield ours, theirs, near


def _same_block(rows: pd.DataFrame) -> bool:
    first = rows.iloc[0]
    return first["cell_a"] == first["cell_b"] and first["part_a"] == first["part_b"]


def _count_block(eps: float):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(rows)
        a_copies, b_copies = a["copies"].to_numpy(), b["copies"].to_numpy()
        a_near, b_near = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        same = _same_block(rows)
        for ours, theirs, near in _near_pieces(a, b, eps):
            # Doubles multiply fast and hold these sums of whole numbers exactly.
            counted = near.astype(np.float64)
            a_near[ours] += (counted @ b_copies[theirs]).astype(np.int64)
            if not same:
                b_near[theirs] += (a_copies[ours] @ counted).astype(np.int64)
        parts = [(a, a_near)] if same else [(a, a_near), (b, b_near)]
        return pd.concat(
            [side[ITEM].assign(near=found) for side, found in parts], ignore_index=True
        )

    return count


def _link_block(eps: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(rows)
        same = _same_block(rows)
        a_core, b_core = a["is_core"].to_numpy(), b["is_core"].to_numpy()
        a_id, b_id = a[INDEX].to_numpy(), b[INDEX].to_numpy()
        # Places of both sides; within a block the sides are the same rows in the same order.
        shift = 0 if same else len(a)
        ids = a_id if same else np.concatenate([a_id, b_id])
        root = np.arange(len(ids))
        found = []
        for ours, theirs, near in _near_pieces(a, b, eps):
            u, v = np.arange(ours.start, ours.stop), np.arange(theirs.start, theirs.stop) + shift
            a_cores, b_cores = a_core[ours][:, None], b_core[theirs][None, :]
            open_pairs = near & a_cores & b_cores & (root[u][:, None] != root[v][None, :])
            joined: dict[int, int] = {}
            for x, y in _forest(open_pairs, u, v):
                x_root, y_root = _find(joined, int(root[x])), _find(joined, int(root[y]))
                if x_root != y_root:
                    joined[max(x_root, y_root)] = min(x_root, y_root)
                    found.append((ids[x], ids[y], True))
            if joined:
                moved = np.arange(len(root))
                moved[list(joined)] = [_find(joined, x) for x in list(joined)]
                root = moved[root]
            for i, j in zip(*np.nonzero(near & ~a_cores & b_cores)):
                found.append((ids[u[i]], ids[v[j]], False))
            if not same:
                for i, j in zip(*np.nonzero(near & a_cores & ~b_cores)):
                    found.append((ids[v[j]], ids[u[i]], False))
        out = pd.DataFrame(found, columns=[INDEX, "other", "both_cores"])
        return out.assign(**{BATCH: rows[BATCH].iloc[0]})

    return link


def _find(joined: dict[int, int], x: int) -> int:
    while joined.get(x, x) != x:
        joined[x] = x = joined.get(joined[x], joined[x])
    return x


def _forest(near: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Each place of a piece with the smallest place it is connected to inside the piece."""
    u_root, v_root = u.copy(), v.copy()
    none = np.iinfo(np.int64).max
    changed = near.any()
    while changed:
        from_v = np.where(near, v_root[None, :], none).min(axis=1)
        new_u = np.minimum(u_root, from_v)
        from_u = np.where(near, new_u[:, None], none).min(axis=0)
        new_v = np.minimum(v_root, from_u)
        changed = (new_u != u_root).any() or (new_v != v_root).any()
        u_root, v_root = new_u, new_v
    return [(i, r) for side, roots in ((u, u_root), (v, v_root)) for i, r in zip(side, roots) if i != r]


class VectorNeighbours:
    """The items of dense vectors, placed into cells for one search distance."""

    def __init__(self, items: DataFrame, eps: float, pivots: int = PIVOTS, block: int = BLOCK):
        if not 0 <= eps < 1:
            raise ValueError("eps must be in [0, 1)")
        self.spark, self.eps = items.sparkSession, eps
        items = items.select(*ITEM, "copies", F.col("signature").alias("vector"))
        # One pivot per half piece or half block, up to a fixed number; chosen by hash.
        wanted = min(pivots, max(1, 2 * items.count() // min(block, PIECE)))
        chosen = items.orderBy(F.xxhash64(*ITEM), *ITEM).limit(wanted).select("vector").toPandas()
        self.pivots = _unit_rows(chosen["vector"]) if len(chosen) else np.zeros((1, 1))
        self.block = min(block, max(PIECE, BLOCK_NUMBERS // self.pivots.shape[1]))
        self.placed = cut(_with_cells(items, self.pivots))

    def counts(self) -> DataFrame:
        """(batch_id, review_index, copies, near): rows within eps of each item, itself excluded."""
        counted = (
            _blocks(self.spark, self.placed, self.pivots, self.eps, self.block)
            .groupBy(*BLOCK_KEY)
            .applyInPandas(_count_block(self.eps), f"{BATCH} long, {INDEX} long, near long")
            .groupBy(*ITEM)
            .agg(F.sum("near").alias("near"))
        )
        return self.placed.select(*ITEM, "copies").join(counted, ITEM).withColumn(
            "near", F.col("near") + F.col("copies") - 1
        )

    def links(self, counts: DataFrame, min_samples: int) -> DataFrame:
        """Links from each item to cores: a forest between cores, and all those of border items."""
        flags = counts.select(*ITEM, (F.col("near") + 1 >= min_samples).alias("is_core"))
        placed = self.placed.join(flags, ITEM)
        return (
            _blocks(self.spark, placed, self.pivots, self.eps, self.block)
            .groupBy(*BLOCK_KEY)
            .applyInPandas(
                _link_block(self.eps), f"{BATCH} long, {INDEX} long, other long, both_cores boolean"
            )
            .distinct()
        )
