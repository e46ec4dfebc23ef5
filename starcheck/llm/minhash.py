"""Near duplicates by bottom-k sketches.

One hash function orders all shingles. A document keeps its k least hashes. Inverted lists of the
retained values show which documents overlap, the sketch of the union estimates the similarity, and
the full sets decide. Documents are linked when 100 * intersection >= threshold * union.

No list is expanded into its pairs:

- Documents with equal sets are one class. Only its smallest document goes on.
- Two linked documents share at least `needed` retained values but for a chance of about 1e-9 (a
  binomial tail; for sets of at most k shingles, surely). So each is listed only under its
  `shared - needed + 1` rarest values. Boilerplate is among the frequent ones and lists nothing.
- Each list has a leader, the document with the most frequent values. All others are compared with
  the leader alone. This joins most of a group of copies.
- What is left of a leader's group, the members of other components than the leader's, is compared
  with the whole group, block by block within tasks. An intersection is at most the smaller
  intersection with the leader plus what the two share outside the leader. Inverted lists over that
  remainder bound it; only what can still reach the threshold is intersected. Tasks give out a
  link per component and block, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch
from starcheck.llm.words import Codes, mix, slices, texts, window_hash
from starcheck.operators.components import connected_components

K = 64
#: Retained values that two linked documents share but for a chance of about 1e-9: of K=64 values
#: of the union's sketch each is in both sets with probability 0.75 or more.
MISS = 1e-9
BLOCK = 256


def needed_values(k: int, percent: int, miss: float = MISS) -> int:
    """The most values that fewer than `miss` of all linked pairs fall short of (binomial)."""
    p, term, total = percent / 100, (1 - percent / 100) ** k, 0.0
    for i in range(k + 1):
        total += term
        if total > miss:
            return max(i, 1)
        term *= (k - i) / (i + 1) * p / (1 - p)
    return k


def _shingles(words: list[bytes], codes: Codes, size: int) -> np.ndarray:
    """The distinct shingles as sorted hashes; of fewer words than that the whole sequence."""
    if len(words) >= size:
        return np.unique(window_hash(codes.of(words), size).view(np.int64))
    if not words:
        return np.zeros(0, np.int64)
    whole = window_hash(codes.of(words), len(words)) + np.uint64(len(words))
    return mix(whole).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]))
    )


def _digests(arrays: list[np.ndarray]) -> np.ndarray:
    joined = b"".join(xxhash.xxh3_128_digest(a.tobytes()) for a in arrays)
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in slices(batches):
            found = [
                _shingles((t or b"").lower().split(), codes, size) for t in texts(batch.column("text"))
            ]
            digests = _digests(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(a) for a in found], pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    _lists([a[:k] for a in found]),
                ],
                names=["doc_id", "n", "d1", "d2", "sketch"],
            )

    return run


def _full_sets(size: int):
    """The full sets of the texts that stand for a class (those with its digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in slices(batches):
            found = [
                _shingles((t or b"").lower().split(), codes, size) for t in texts(batch.column("text"))
            ]
            own = _digests(found)
            same = (own[:, 0] == batch.column("d1").to_numpy()) & (own[:, 1] == batch.column("d2").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "score", "prefix")]
            yield pa.RecordBatch.from_arrays(
                [*columns, _lists(found)], names=["doc_id", "score", "prefix", "shingles"]
            ).filter(pa.array(same))

    return run


def _listed(values: DataFrame, k: int, needed: int, percent: int) -> DataFrame:
    """(doc_id, n, score, prefix): the rarest shared values each document is listed under."""
    least = F.least(F.lit(needed), F.ceil(F.col("n") * percent / 100))
    values = values.groupBy("doc_id").agg(
        F.first("n").alias("n"),
        F.count("*").alias("shared"),
        F.sum("df").alias("score"),
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_df"),
    )
    return values.filter(F.col("shared") >= least).select(
        "doc_id",
        "n",
        "score",
        F.transform(
            F.slice("by_df", F.lit(1), (F.col("shared") - least + 1).cast("int")), lambda x: x["v"]
        ).alias("prefix"),
    )


def _sketch_filter(k: int, percent: int, needed: int):
    """Pairs whose union sketch has as many common values as linked pairs have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            pairs = zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)
            for own, other in pairs:
                union = sorted({*own, *other})[:k]
                common = len({*own}.intersection(other, union))
                exact = len(union) < k
                keep.append(100 * common >= percent * len(union) if exact else common >= needed)
            yield batch.select(["doc_id", "leader"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(percent: int):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            pairs = zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)
            for own, other in pairs:
                both = len({*own}.intersection(other))
                keep.append((100 + percent) * both >= percent * (len(own) + len(other)))
            yield batch.select(["doc_id", "leader"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Links between an open block and a block of its leader's group, one per component."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        head = next(s for s in rows["leader_set"] if s is not None)
        leader = np.sort(np.array(head, np.int64))
        real = [k for k, d in enumerate(rows["doc_id"]) if d is not None]
        ids, roots = ([rows[c][k] for k in real] for c in ("doc_id", "root"))
        sets = [np.array(rows["shingles"][k], np.int64) for k in real]
        is_open = np.array([rows["open"][k] for k in real], bool)
        left, right = np.flatnonzero(is_open), np.flatnonzero(~is_open)
        roots = np.array(roots, np.int64)
        n = np.array([len(s) for s in sets])
        rest = [np.setdiff1d(s, leader, assume_unique=True) for s in sets]
        common = n - np.array([len(r) for r in rest])
        # Inverted lists over what the right side has outside the leader.
        owner = np.repeat(np.arange(len(right)), [len(rest[j]) for j in right])
        values = np.concatenate([np.zeros(0, np.int64), *(rest[j] for j in right)])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        links = []
        for i in left:
            lo = np.searchsorted(values, rest[i], "left")
            hi = np.searchsorted(values, rest[i], "right")
            hits = [owner[a:b] for a, b in zip(lo, hi, strict=True) if b > a]
            found = np.bincount(np.concatenate(hits), minlength=len(right)) if hits else 0
            bound = np.minimum(common[i], common[right]) + found
            # 100 * both >= percent * (n + m - both) for the largest possible intersection
            may = (100 + percent) * bound >= percent * (n[i] + n[right])
            seen = {roots[i]}
            for j in right[np.flatnonzero(may & (roots[right] != roots[i]))]:
                if roots[j] in seen:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if (100 + percent) * both >= percent * (n[i] + n[j]):
                    seen.add(roots[j])
                    links.append((ids[i], ids[j]))
        return pa.table(
            {
                "u": pa.array([u for u, _ in links], pa.int64()),
                "v": pa.array([v for _, v in links], pa.int64()),
            }
        )

    return run


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of each component; root is its smallest node."""
    found = connected_components(links.select(F.lit(0).alias("batch_id"), "u", "v"))
    return found.select("node", "root")


def near_duplicates(
    docs: DataFrame, *, percent: int = 75, size: int = 5, k: int = K, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text).

    A-Z are lower-cased; words are runs of anything but ASCII white space; a set holds the distinct
    shingles of `size` words, or the whole sequence if that is shorter. A null, empty or blank text
    has no shingles and is linked with nothing. component_id is the smallest doc_id that links
    lead to; rows with the same doc_id are ends of the same links. A row without doc_id gets a null
    component and is kept. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    needed = needed_values(k, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    sets = scratch.write(
        rows.mapInArrow(
            _sketches(size, k), "doc_id long, n long, d1 long, d2 long, sketch array<long>"
        ),
        "sets",
    )
    digest = ["d1", "d2"]
    classes = scratch.write(
        sets.filter("n > 0 and doc_id is not null")
        .groupBy(*digest)
        .agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    # Of rows with one doc_id and several sets, the set with the least digest stands for the id.
    ids = scratch.write(
        classes.groupBy(F.col("first").alias("doc_id"))
        .agg(F.min(F.struct(*digest)).alias("d"), F.count("*").alias("m"))
        .select("doc_id", "d.d1", "d.d2", "m"),
        "ids",
    )
    standing = classes.select(F.col("first").alias("doc_id"), *digest, "n", "sketch")
    if not ids.filter("m > 1").isEmpty():
        standing = standing.join(ids.drop("m"), ["doc_id", *digest], "left_semi")

    # Retained values that more than one class has, and the rarest of them for each class.
    values = standing.select("doc_id", "n", F.explode("sketch").alias("v"))
    df = scratch.write(
        values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "df"
    )
    listed = _listed(values.join(df, "v"), k, needed, percent)
    listed = scratch.write(listed.join(ids.drop("m"), "doc_id"), "listed")
    scratch.drop("df")
    chosen = scratch.write(
        rows.join(listed, "doc_id")
        .mapInArrow(
            _full_sets(size), "doc_id long, score long, prefix array<long>, shingles array<long>"
        )
        .dropDuplicates(["doc_id"]),
        "chosen",
    )
    scratch.drop("listed")

    # Each list is compared with its leader.
    lists = chosen.select("doc_id", "score", F.explode("prefix").alias("v"))
    leaders = scratch.write(
        lists.groupBy("v")
        .agg(F.max(F.struct("score", -F.col("doc_id"))).alias("top"), F.count("*").alias("m"))
        .filter("m > 1")
        .select("v", (-F.col("top.col2")).alias("leader")),
        "leaders",
    )
    pairs = scratch.write(
        lists.join(leaders, "v").filter("doc_id != leader").select("doc_id", "leader").distinct(),
        "pairs",
    )
    own = chosen.select("doc_id", F.col("shingles").alias("own"))
    heads = scratch.write(
        own.join(pairs.select(F.col("leader").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("leader"), F.col("own").alias("other")),
        "heads",
    )
    first_k = lambda name: F.slice(name, 1, k).alias(name)
    likely = scratch.write(
        pairs.join(own.select("doc_id", first_k("own")), "doc_id")
        .join(heads.select("leader", first_k("other")), "leader")
        .mapInArrow(_sketch_filter(k, percent, needed), "doc_id long, leader long"),
        "likely",
    )
    links = scratch.write(
        likely.join(own, "doc_id")
        .join(heads, "leader")
        .mapInArrow(_confirm(percent), "doc_id long, leader long")
        .select(F.col("doc_id").alias("u"), F.col("leader").alias("v")),
        "links",
    )
    roots = scratch.write(_roots(links), "roots")

    # The rest of each leader's group.
    def root(rows: DataFrame, column: str, name: str) -> DataFrame:
        found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
        return rows.join(found, column, "left").withColumn(name, F.coalesce(name, column))

    group = root(root(pairs, "doc_id", "root"), "leader", "leader_root")
    group = scratch.write(group.withColumn("open", F.col("root") != F.col("leader_root")), "group")
    sizes = scratch.write(
        group.groupBy("leader")
        .agg(F.count("*").alias("m"), F.sum(F.col("open").cast("long")).alias("m_open"))
        .filter("m_open > 0 and m > 1")
        .select(
            "leader",
            F.ceil(F.col("m") / block).alias("right_blocks"),
            F.ceil(F.col("m_open") / block).alias("left_blocks"),
        ),
        "sizes",
    )
    spot = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count))
    every = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    members = group.join(sizes, "leader")
    left = members.filter("open").select(
        "leader", "doc_id", "root", F.lit(True).alias("open"),
        spot("left_blocks").alias("i"), F.explode(every("right_blocks")).alias("j"),
    )
    right = members.select(
        "leader", "doc_id", "root", F.lit(False).alias("open"),
        F.explode(every("left_blocks")).alias("i"), spot("right_blocks").alias("j"),
    )
    heads_open = heads.join(sizes.select("leader", "left_blocks", "right_blocks"), "leader").select(
        "leader",
        F.explode(every("left_blocks")).alias("i"),
        "right_blocks",
        "other",
    )
    heads_open = heads_open.select(
        "leader", "i", F.explode(every("right_blocks")).alias("j"), F.col("other").alias("leader_set")
    )
    lines = (
        left.unionByName(right)
        .join(own.withColumnRenamed("own", "shingles"), "doc_id")
        .withColumn("leader_set", F.lit(None).cast("array<long>"))
        .unionByName(
            heads_open.select(
                "leader", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("root"),
                F.lit(None).cast("boolean").alias("open"), "i", "j",
                F.lit(None).cast("array<long>").alias("shingles"), "leader_set",
            )
        )
    )
    more = scratch.write(
        lines.groupBy("leader", "i", "j").applyInArrow(_block_links(percent), "u long, v long"), "more"
    )
    component = scratch.write(_roots(links.unionByName(more)), "component")
    of_class = scratch.write(
        classes.join(
            component.select(F.col("node").alias("first"), "root"), "first", "left"
        ).select("d1", "d2", F.coalesce("root", "first").alias("root")),
        "of_class",
    )
    has = F.col("n") > 0
    result = scratch.write(
        sets.select("doc_id", "n", *digest)
        .join(of_class, digest, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(has & F.col("doc_id").isNotNull(), F.col("root"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))),
        "result",
    )
    scratch.drop(
        "sets", "classes", "ids", "chosen", "leaders", "pairs", "heads", "likely", "links", "roots",
        "group", "sizes", "more", "component", "of_class",
    )
    return result
