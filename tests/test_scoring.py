import pytest
from pyspark.sql import functions as F

from starcheck.operators import clean, mismatch
from starcheck.operators.mismatch import score_mismatch, score_rejects, verdicts
from starcheck.plans.analyze import analyze_rows

CASES = [
    (5, "The hinge broke in the hall, a waste of glue, and a terrible squeak ever since", "negative", 0.99, 0.742),
    (5, "Sturdy stool, easy on the knees, and the grey one works in our bath", "positive", 0.99, 0.0),
    (1, "Happy cat, perfect cushion, sturdy frame: we love Sundays now", "positive", 0.99, 0.742),
    (1, "Horrible rattle, then junk; it died under the sink", "negative", 0.99, 0.0),
    (3, "A grey stool with four legs stands near the window", "neutral", 0.5, 0.0),
    (5, "great good love bad", "positive", 0.75, 0.0),
    (1, "great good love bad", "positive", 0.75, 0.562),
    (1, "nothing to say", "neutral", 0.5, 0.125),
    (5, "nothing to say", "neutral", 0.5, 0.125),
    (3, "great", "positive", 0.99, 0.247),
    (0, "great", "positive", 0.99, 0.99),
]


def frame(spark, rows):
    return spark.createDataFrame([(str(i), *row) for i, row in enumerate(rows)], "review_id string, rating int, text string")


def test_hand_checked_scores(spark):
    df = score_mismatch(frame(spark, [c[:2] for c in CASES]), threshold=0.4)
    for row in df.collect():
        _, _, sentiment, confidence, score = CASES[int(row.review_id)]
        assert (row.predicted_sentiment, row.sentiment_confidence, row.mismatch_score) == (sentiment, confidence, score)
        assert row.is_flagged == (score >= 0.4)


def test_reasons(spark):
    df = score_mismatch(frame(spark, [(5, "bad"), (5, "good"), (1, "great great good love best bad bad bad")]))
    assert [r.reason for r in df.orderBy("review_id").collect()] == [
        "text reads as negative (confidence 0.99) but rating is 5 stars - expected sentiment for that rating range is different",
        "text sentiment (positive) is consistent with a 5-star rating",
        "text reads as positive (confidence 0.62) but rating is 1 stars - expected sentiment for that rating range is different",
    ]


def test_score_bounds_and_monotone_flags(spark):
    words = ["", "good", "bad", "good good bad", "bad bad good"]
    rows = [(r, w) for r in range(1, 6) for w in words]
    low = score_mismatch(frame(spark, rows), threshold=0.3).collect()
    high = {r.review_id: r.is_flagged for r in score_mismatch(frame(spark, rows), threshold=0.5).collect()}
    for row in low:
        assert 0 <= row.mismatch_score <= 0.75
        assert (row.mismatch_score == 0) == (row.low <= row.rating <= row.high)
        assert row.is_flagged or not high[row.review_id]


def test_unknown_label(spark):
    def odd(df):
        return df.withColumns({"predicted_sentiment": F.lit("odd"), "confidence": F.lit(0.9)})

    df = frame(spark, [(5, "x")])
    assert score_rejects(score_mismatch(df, odd)).count() == 1
    with pytest.raises(Exception, match="unknown sentiment odd"):
        score_mismatch(df, odd, strict=True).collect()


def test_validation(spark):
    rows = [(7, "fine"), (3, ""), (3, "x" * 5001), (3, "x" * 5000), (3, " "), (None, "a"), (2, None), (0, "a"), (3, "\U0001f600" * 5000)]
    df = frame(spark, rows)
    assert [r.review_id for r in clean.validate(df).orderBy("review_id").collect()] == ["3", "4", "8"]
    reasons = {r.review_id: r.reject_reason for r in clean.rejects(df, reject_blank=True).collect()}
    assert reasons == {
        "0": "rating_out_of_range", "1": "text_too_short", "2": "text_too_long", "4": "text_blank",
        "5": "rating_missing", "6": "text_missing", "7": "rating_out_of_range",
    }


def test_null_texts(spark):
    df = frame(spark, [(3, None), (5, "a"), (1, " \n ")])
    assert [r.label for r in clean.load_and_clean(df).collect()] == [2]
    kept = clean.load_and_clean(df, null_text="literal").orderBy("review_id").collect()
    assert [(r.text, r.label) for r in kept] == [("nan", 1), ("a", 2)]


def test_truth_split_leaves_unmarked_rows_out(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_mismatch boolean")
    marked, fine = clean.truth_split(df)
    assert [r.id for r in marked.collect()] == [1] and [r.id for r in fine.collect()] == [2]


def test_explanations(spark):
    rows = [
        (5, "Horrible rattle, then junk; it died under the sink"),
        (5, "Sturdy stool, easy on the knees"),
        (1, "good bad good good good good good good good good"),
    ]
    found = {r.review_id: r for r in analyze_rows(frame(spark, rows)).collect()}
    assert [tuple(t) for t in found["0"].explanation] == [("horrible", -1.0), ("junk", -1.0), ("died", -1.0)]
    assert found["0"].explanation_method == "lexicon_fallback"
    assert found["1"].explanation is None and found["1"].explanation_method is None
    assert [t.token for t in found["2"].explanation] == ["good", "bad"] + ["good"] * 6
    assert {t.weight for t in found["2"].explanation} == {1.0}


def test_sweep_needs_no_rows_of_a_class(spark):
    df = frame(spark, [(5, "bad")]).withColumn("is_mismatch", F.lit(True))
    row = mismatch.sweep_thresholds(score_mismatch(df), [0.3]).first()
    assert row.recall == 1.0 and row.false_positive_rate is None


def test_verdicts(spark):
    row = verdicts(score_mismatch(frame(spark, [(5, "bad")]))).first()
    assert (row.word, row.heading, row.confidence_percent) == ("Flagged", "Mismatch detected", 99)
