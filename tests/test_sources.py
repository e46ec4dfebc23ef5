import json

import pytest
from pyspark.sql import functions as F

from starcheck.functions.labels import pseudo_rating
from starcheck.plans.analyze import analyze_rows
from starcheck.schema import REVIEW_COLUMNS, REVIEWS
from review_generator import generate_reviews
from starcheck.sources.requests import parse_requests, reject_batches, to_json_row
from starcheck.sources.reviews_io import normalize_source, read_reviews, write_reviews
from starcheck.sources.runs import append_runs, comparison_table, log_run, read_runs
from starcheck.streaming.analyze_stream import (
    analyze_stream,
    read_request_stream,
    write_duplicates,
    write_stream,
)


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_review_files_keep_every_text(spark, tmp_path, form):
    texts = ['a, b', 'say "hi"', "two\nlines", " outer space ", "back\\slash", '"', "plain"]
    rows = [(i, "x", 3, t, None, i % 2 == 0, None) for i, t in enumerate(texts)]
    write_reviews(spark.createDataFrame(rows, REVIEWS), str(tmp_path / "r"), form)
    back = read_reviews(spark, str(tmp_path / "r"), form)
    assert back.columns == REVIEW_COLUMNS
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_normalize_source(spark):
    df = spark.createDataFrame([(30, " b\nc ", 1), (10, "a", 0)], "id long, content string, label int")
    rows = normalize_source(df, "amazon_polarity", "id").orderBy("review_id").collect()
    assert [(r.review_id, r.rating, r.text, r.product_category) for r in rows] == [
        (1, 1, "a", "unknown"), (2, 5, "b c", "unknown"),
    ]
    assert rows[0].true_sentiment is None and rows[0].is_mismatch is None
    with pytest.raises(ValueError, match="unknown source"):
        normalize_source(df, "other", "id")
    with pytest.raises(Exception, match="unknown source other"):
        spark.range(1).select(pseudo_rating(F.lit("other"), F.lit(1))).collect()


@pytest.mark.parametrize("n,mismatches,fakes,genuine", [(200, 24, 16, 160), (1, 0, 4, 0), (100, 12, 8, 80)])
def test_generator_mix(spark, n, mismatches, fakes, genuine):
    rows = generate_reviews(spark, n).collect()
    assert sum(r.is_mismatch for r in rows) == mismatches
    assert sum(r.is_templated_fake for r in rows) == fakes
    assert len(rows) == mismatches + fakes + genuine
    for row in rows:
        if row.is_mismatch:
            assert (row.true_sentiment == "negative") == (row.rating > 3)
        elif not row.is_templated_fake:
            assert {"negative": row.rating < 3, "neutral": row.rating == 3, "positive": row.rating > 3}[row.true_sentiment]


def test_requests(spark):
    bodies = [
        '{"rating": 5, "text": "one", "review_id": "a"}',
        '{"reviews": [{"rating": 5, "text": "x"}, {"rating": 1, "text": "y", "review_id": "b"}]}',
        '{"reviews": []}',
        '{"reviews": [',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "batch_id long, body string")
    assert [tuple(r) for r in parse_requests(df).orderBy("batch_id", "review_index").collect()] == [
        (0, 0, 5, "one", "a"), (1, 0, 5, "x", None), (1, 1, 1, "y", "b"),
    ]
    assert {r.batch_id: r.reject_reason for r in reject_batches(df).collect()} == {2: "empty_batch", 3: "malformed_body"}


def test_analysis_as_json(spark):
    df = spark.createDataFrame([("r1", 5, "bad"), (None, 5, "good")], "review_id string, rating int, text string")
    rows = analyze_rows(df)
    flagged, fine = [json.loads(r[0]) for r in rows.orderBy(F.desc("is_flagged")).select(to_json_row(rows.columns)).collect()]
    assert flagged["explanation"] == [{"token": "bad", "weight": -1.0}] and flagged["mismatch_score"] == 0.742
    assert fine["explanation"] is None and fine["review_id"] is None and list(fine) == rows.columns


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    log_run(spark, path, experiment="e", run="a", model_type="m", accuracy=0.5, f1_macro=0.4)
    log_run(spark, path, experiment="e", run="b", model_type="m", accuracy=0.6, f1_macro=0.7, latency_ms=1.0)
    append_runs(spark.createDataFrame([("e", "c")], "experiment string, run string"), path)
    log_run(spark, path, experiment="other", run="d", f1_macro=1.0)
    table = comparison_table(read_runs(spark, path, "e"))
    assert [r.run for r in table.collect()] == ["b", "a", "c"]
    assert comparison_table(table.drop("latency_ms")).columns == ["run", "model_type", "accuracy", "f1_macro"]
    with pytest.raises(ValueError, match="no experiment named none"):
        read_runs(spark, path, "none")


def request_files(spark, folder):
    rows = [(i % 7, t, f"r{i}") for i in range(40) for t in ["Bad junk", "Good and great thing", ""]]
    df = spark.createDataFrame(rows, "rating int, text string, review_id string")
    df.repartition(5).write.json(str(folder))
    return df


def test_stream_equals_batch(spark, tmp_path):
    rows = request_files(spark, tmp_path / "in")
    stream = read_request_stream(spark, str(tmp_path / "in"))
    write_stream(analyze_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    expected = analyze_stream(rows)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == expected.count() > 0
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    # A second start finds nothing new.
    write_stream(analyze_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == expected.count()


def test_stream_duplicates_per_micro_batch(spark, tmp_path):
    rows = spark.range(0, 12).select(
        "id", F.lit(5).alias("rating"), F.when(F.col("id") < 5, "just the same text").otherwise(F.concat(F.lit("other t"), "id")).alias("text")
    )
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, rating int, text string").json(str(tmp_path / "in"))
    write_duplicates(stream, str(tmp_path / "out"), str(tmp_path / "state"), "id").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.cluster_id, r.size, r.first_index, r.micro_batch) for r in found] == [(0, 5, 0, 0)]
