"""Whitening through BlockMatrix against numpy on all rows at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starcheck.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = {}
    for _, v in kept:
        lengths[len(v)] = lengths.get(len(v), 0) + 1
    d = max(lengths, key=lambda k: (lengths[k], k))
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    centred = x - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)
    return kept, n, deviation, centred, e[order], u[:, order], np.trace(cov)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.3
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [rows[5], (900, None), (901, [1.0] * 11), (902, [float("nan")] + [0.0] * 11),
             (903, [float("inf")] + [0.0] * 11), (904, [None] + [0.0] * 11), (None, [0.5] * 12)]
    df = spark.createDataFrame(rows, SCHEMA.replace(", label int", "")).withColumn("component", F.lit("x"))
    got = whitening.whiten(df).collect()
    kept, n, deviation, centred, e, u, trace = plain(rows)
    assert {r.n for r in got} == {n} and len(got) == 8 * n
    ids = [i for i, _ in kept]
    key = lambda i: -1 if i is None else i
    assert sorted((r.vec_id for r in got if r.component == 1), key=key) == sorted(ids, key=key)
    err = {r.identity_error for r in got}
    assert len(err) == 1 and err.pop() <= 1e-4
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(8):
        assert abs([r for r in got if r.component == c + 1][0].explained - e[c] / trace) <= 1e-4 * e[c] / trace
        w = centred @ u[:, c] / math.sqrt(e[c])
        sign = None
        for row, (i, _) in enumerate(kept):
            r = by[(i, c + 1)][0]
            assert r.deviation == deviation[row]
            sign = sign or (1 if r.whitened * w[row] > 0 else -1)
            assert abs(r.whitened - sign * w[row]) <= 1e-6 * max(1.0, abs(w[row]))


def test_whitening_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    only_bad = spark.createDataFrame([(1, None), (2, [float("nan")])], "vec_id long, embedding array<float>")
    assert whitening.whiten(only_bad).collect() == []
    constant = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whiten(constant).collect() == []
    few = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(few).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 2
    assert sorted(round(r.whitened, 9) for r in rows) == [-1.0, 1.0]
