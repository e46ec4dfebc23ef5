"""The nested batch answer in bounded parts, and the three sinks of a request stream."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from starcheck.sources import batch_answer
from starcheck.streaming import request_sinks

RESULTS = "batch_id long, review_index long, review_id string, is_flagged boolean, cluster_id long"
CLUSTERS = "batch_id long, cluster_id long, size long, first_index long, representative_text string"


def test_parts_are_bounded_and_read_back(spark):
    rows = [(1, i, f"r{i}", i % 3 == 0, 7 if i % 2 else None) for i in range(11)]
    rows += [(2, 5, "x", False, None), (None, 1, "lost", True, None)]
    results = spark.createDataFrame(rows, RESULTS)
    clusters = spark.createDataFrame([(1, 7, 5, 1, "text of one")], CLUSTERS)
    docs = batch_answer.answer_documents(results, clusters, rows_per_part=4)
    bodies = [json.loads(r.body) for r in docs.collect()]
    parts = [b for b in bodies if b["kind"] == "part"]
    assert all(len(b["results"]) <= 4 and all(len(c["review_indices"]) <= 4 for c in b["clusters"]) for b in parts)
    assert sorted((b["batch_id"], b["part"]) for b in parts) == [(1, 0), (1, 1), (1, 2), (2, 1)]
    one = [b for b in parts if b["batch_id"] == 1]
    assert sorted(i for b in one for c in b["clusters"] for i in c["review_indices"]) == [1, 3, 5, 7, 9]
    manifests = {b["batch_id"]: b["manifest"] for b in bodies if b["kind"] == "manifest"}
    assert manifests == {1: {"parts": 3, "results": 11, "clusters": 1}, 2: {"parts": 1, "results": 1, "clusters": 0}}
    path = os.path.join(tempfile.mkdtemp(), "answer")
    batch_answer.write_answer(docs, path)
    back = {(r.batch_id, r.part): r for r in batch_answer.read_answer(spark, path).collect()}
    assert (back[(1, 0)].n_results, back[(1, 0)].n_flagged, back[(1, 0)].n_members) == (4, 2, 2)
    assert (back[(1, -1)].n_parts, back[(1, -1)].n_results, back[(1, -1)].n_clusters) == (3, 11, 1)
    assert batch_answer.answer_documents(results.limit(0), clusters.limit(0)).collect() == []


def test_every_body_lands_in_one_sink(spark):
    bodies = [
        (1, '{"reviews": [{"rating": 5, "text": "good", "review_id": "a"}, {"rating": 9, "text": "x", "review_id": "b"}]}'),
        (2, '{"rating": 1, "text": "bad", "review_id": "c"}'),
        (3, '{"reviews": []}'),
        (4, '{"reviews": [{"rat'),
        (5, None),
        (6, '{"reviews": [{"rating": 3, "text": "", "review_id": "d"}]}'),
    ]
    batch = spark.createDataFrame(bodies, "batch_id long, body string").withColumn("reject_reason", F.lit("clash"))
    out = {k: v.collect() for k, v in request_sinks.split_batch(batch.drop("reject_reason")).items()}
    assert sorted((r.batch_id, r.review_index) for r in out["analysis"]) == [(1, 0), (2, 0)]
    assert sorted((r.batch_id, r.review_index, r.reject_reason) for r in out["row_rejects"]) == [
        (1, 1, "rating_out_of_range"), (6, 0, "text_too_short")]
    got = sorted((r.batch_id, r.reject_reason, r.body) for r in out["body_rejects"])
    assert got == [(3, "empty_batch", '{"reviews": []}'), (4, "malformed_body", '{"reviews": [{"rat'), (5, "malformed_body", None)]
