"""Embedding whitening through Spark MLlib's BlockMatrix.

The rows that stay (see `clean`) become integer vectors x = floor(1024 * c) + 100000. Each row gets a
dense index, its centred vector x - S/n becomes a row of an IndexedRowMatrix, and that is cut into
blocks of ROWS_PER_BLOCK rows. The scatter matrix is the BlockMatrix product C^T C, summed block by block
on the executors; only the d x d result reaches the driver, where numpy's eigh finds the components. The
whitening matrix U_k / sqrt(e_k) goes back as a one-block BlockMatrix and C times it projects every row.
The covariance of the projected rows is found the same way, P^T P / n, to report how far it is from the
identity.

Defined results:
- A row is dropped when its vector is null, holds a null, NaN or infinite entry, or is shorter or longer
  than the vectors of the most common length (ties: the longest). Repeated rows are rows like others.
- n is the number of remaining rows; with none, or vectors of length 0, there are no rows.
- Components are numbered by falling eigenvalue; each unit vector has its largest entry (first, among
  equal ones) positive. A component whose eigenvalue is not above 1e-12 of the trace has no whitened
  value and is left out (a constant table has none).
- deviation = sum over dimensions of (n*x - S)^2, in decimals of 38 digits, then as a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRow, IndexedRowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch

# Fixed values of the contract: the scale and shift of the integer vectors, the number of components.
SCALE, SHIFT = 1024, 100000
COMPONENTS = 8

ROWS_PER_BLOCK = 1024
#: Eigenvalues up to this share of the trace count as zero.
TINY = 1e-12


def clean(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows with finite vectors of the most common length."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    rows = rows.filter(v.isNotNull() & finite)
    x = F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(SHIFT))
    rows = rows.select("vec_id", x.alias("x"), F.size(v).alias("d"))
    common = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.filter("false").drop("d")
    return rows.filter(F.col("d") == common["d"]).drop("d")


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the per-dimension sums S, aggregated partially on every executor."""
    n = rows.count()
    per = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()
    sums = [0] * len(per)
    for r in per:
        sums[r["i"]] = int(r["s"])
    return n, sums


def _components(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    cov = scatter / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")
    e, u = e[order], u[:, order]
    top = np.argmax(np.abs(u), axis=0)
    u = u * np.where(u[top, np.arange(u.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    keep = e > TINY * trace if trace > 0 else np.zeros(len(e), bool)
    keep[COMPONENTS:] = False
    return e[keep], u[:, keep], trace


def whiten(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = scratch.write(clean(embeddings), "rows")
    n, sums = _sums(rows)
    d = len(sums)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n == 0 or d == 0:
        return spark.createDataFrame([], empty)

    means = [s / n for s in sums]
    indexed = rows.rdd.zipWithIndex().map(lambda p: (p[1], p[0]["vec_id"], p[0]["x"]))
    table = scratch.write(spark.createDataFrame(indexed, "index long, vec_id long, x array<long>"), "indexed")
    centred = table.rdd.map(lambda r: IndexedRow(r["index"], [v - m for v, m in zip(r["x"], means, strict=True)]))
    blocks = IndexedRowMatrix(centred, n, d).toBlockMatrix(ROWS_PER_BLOCK, d)
    scatter = blocks.transpose().multiply(blocks).toLocalMatrix().toArray()
    e, u, trace = _components(scatter, n)
    k = len(e)
    if k == 0:
        return spark.createDataFrame([], empty)
    whitening = u / np.sqrt(e)
    right = spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, whitening.flatten(order="F").tolist()))])
    projected = blocks.multiply(BlockMatrix(right, d, k, d, k))
    flat = projected.toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    whitened = scratch.write(spark.createDataFrame(flat, "index long, w array<double>"), "projected")
    again = IndexedRowMatrix(whitened.rdd.map(lambda r: IndexedRow(r["index"], r["w"])), n, k).toBlockMatrix(ROWS_PER_BLOCK, k)
    covariance = again.transpose().multiply(again).toLocalMatrix().toArray() / n
    error = float(np.max(np.abs(covariance - np.eye(k))))

    deviation = _deviation(n, sums)
    out = table.join(whitened, "index").select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        deviation.alias("deviation"),
        F.posexplode("w").alias("c", "whitened"),
    )
    explained = F.element_at(F.lit((e / trace).tolist()), F.col("c") + 1)
    return out.select(
        "vec_id",
        (F.col("c") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _deviation(n: int, sums: list[int]):
    """sum over dimensions of (n*x - S)^2, exact in 38-digit decimals, as a long."""
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    big_n = F.lit(n).cast("decimal(38,0)")

    def square(v, i):
        diff = big_n * v.cast("decimal(38,0)") - F.get(total, i)
        return (diff * diff).cast("decimal(38,0)")

    return F.aggregate(F.transform("x", square), F.lit(0).cast("decimal(38,0)"), lambda acc, y: (acc + y).cast("decimal(38,0)")).cast("long")
