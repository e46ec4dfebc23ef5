"""Bradley-Terry quality scores: held-out accuracy, the pair loss at its optimum, defined edge cases."""

from starcheck.llm import preference


def test_held_out_accuracy_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = preference.classify(docs, labels).join(labels, "doc_id")
    rows = scored.filter("held_out").collect()
    assert len(rows) > 50
    right = sum(r.predicted == r.quality for r in rows)
    assert right / len(rows) >= 0.9
    assert all(0.0 <= r.score <= 1.0 for r in rows)
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in rows)


def test_held_out_pairs_are_ordered(spark):
    """Bradley-Terry's own measure, brute force over all held-out (good, bad) pairs: AUC."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = preference.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.raw for r in rows if r.quality == 1]
    bad = [r.raw for r in rows if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) >= 0.95


def test_edge_cases(spark, docs, null_id, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (6, 1, 0), (9, 0, 1), (12, 1, 0), (15, 0, 0), (18, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = preference.classify(null_id, labels).collect()
    assert len(got) == null_id.count()
    assert all(0.0 <= r.score <= 1.0 and r.predicted in (0, 1) for r in got)
    assert preference.classify(no_docs, labels).collect() == []
    one_kind = preference.classify(docs, labels.filter("quality = 1")).collect()
    assert {round(r.score, 12) for r in one_kind} == {0.7} and {r.predicted for r in one_kind} == {1}
