"""Ranked lexical search against a plain scoring of every document."""

import collections
import math
import re

from pyspark.sql import functions as F

from starcheck.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    if text is None:
        return []
    return TERM.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, top=50):
    counted = [(doc_id, collections.Counter(plain_terms(text))) for doc_id, text in docs]
    big_n = sum(1 for _, c in counted if c)
    big_l = sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = collections.defaultdict(set)
    for item_id, text in items:
        queries[item_id] |= set(plain_terms(text))
    out = []
    for item_id, q in queries.items():
        scored = []
        for doc_id, c in counted:
            n = sum(c.values())
            m = 50 + (50 * n * big_n) // big_l if big_l else 50
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if c[t])
            if score > 0:
                scored.append((score, doc_id))
        scored.sort(key=lambda x: (-x[0], float("inf") if x[1] is None else x[1]))
        out += [(item_id, r + 1, d, s) for r, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=str)


def test_search_equals_plain_scoring(spark, docs, rows):
    picked = [r[1] for r in rows if r[1]][:12]
    items = [(k, " ".join((t or "").split()[k : k + 30])) for k, t in enumerate(picked)]
    items += [(100, None), (101, "Zz ÉCOLE w1 w1"), (102, "w3"), (102, "w7 w9")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    for top in (50, 3):
        got = sorted(map(tuple, search.search(docs, table, top=top).collect()), key=str)
        want = brute([(r[0], r[1]) for r in rows], items, top)
        assert got == want


def test_search_on_null_ids_empty_tables(spark, null_id, no_docs):
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, "")], "item_id long, text string")
    got = sorted(map(tuple, search.search(null_id, items).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in null_id.collect()], [(1, "w1 w2 w3"), (2, "")])
    assert any(r[2] is None for r in got)
    assert search.search(no_docs, items).collect() == []
    assert search.search(null_id, items.filter("false")).collect() == []


def test_threshold_prunes_and_stays_exact(spark):
    """Many documents of few, equal terms: ties at the threshold rank by doc_id."""
    rows = [(k, "alpha beta " * (1 + k % 7) + f"gamma{k % 3}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "alpha gamma1"), (2, "beta"), (3, "gamma2 missing")]
    got = sorted(map(tuple, search.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute(rows, items)
