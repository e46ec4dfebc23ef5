"""How far the sentiment of a text disagrees with its stars."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.lexicon import (
    lexicon_confidence,
    lexicon_hits,
    lexicon_label,
    positive_hits,
)
from starcheck.functions.numeric import round_half_even_exact
from starcheck.functions.once import once

Transform = Callable[[DataFrame], DataFrame]

# The stars that fit each sentiment, ends included.
EXPECTED_RANGES = {"negative": (1, 2), "neutral": (2, 4), "positive": (4, 5)}
DEFAULT_THRESHOLD = 0.35


def lexicon_classifier(df: DataFrame) -> DataFrame:
    """Add predicted_sentiment, confidence and the hits they rest on."""
    negative = F.size("hits") - F.col("positive_hits")
    return (
        once(df, hits=lexicon_hits(F.col("text")))
        .withColumn("positive_hits", positive_hits(F.col("hits")))
        .withColumns(
            {
                "predicted_sentiment": lexicon_label(F.col("positive_hits"), negative),
                "confidence": lexicon_confidence(F.col("positive_hits"), negative),
            }
        )
        .drop("positive_hits")
    )


def expected_bound(sentiment: Column, ranges: dict[str, tuple[int, int]], end: int) -> Column:
    """Lower (end=0) or upper (end=1) end of the range of a sentiment; null if unknown."""
    bound = F.lit(None).cast("int")
    for name, limits in ranges.items():
        bound = F.when(sentiment == name, limits[end]).otherwise(bound)
    return bound


def with_expected_range(
    df: DataFrame,
    ranges: dict[str, tuple[int, int]] = EXPECTED_RANGES,
    strict: bool = False,
) -> DataFrame:
    """Add low and high. An unknown sentiment gives nulls, or an error if strict."""
    sentiment = F.col("predicted_sentiment")
    low = expected_bound(sentiment, ranges, 0)
    if strict:
        message = F.concat(F.lit("unknown sentiment "), F.coalesce(sentiment, F.lit("null")))
        low = F.coalesce(low, F.raise_error(message).cast("int"))
    return df.withColumns({"low": low, "high": expected_bound(sentiment, ranges, 1)})


def range_distance(rating: Column, low: Column, high: Column) -> Column:
    """Steps to the nearer end of the range over the widest gap of four; 0 inside."""
    outside = F.least(F.abs(rating - low), F.abs(rating - high)) / 4.0
    return F.when(rating.between(low, high), 0.0).when(low.isNotNull(), outside)


def reason_sentence(distance: Column, sentiment: Column, confidence: Column, rating: Column) -> Column:
    agrees = F.format_string("text sentiment (%s) is consistent with a %d-star rating", sentiment, rating)
    clashes = F.format_string(
        "text reads as %s (confidence %.2f) but rating is %d stars"
        " - expected sentiment for that rating range is different",
        sentiment,
        round_half_even_exact(confidence, 2),
        rating,
    )
    return F.when(distance == 0, agrees).when(distance.isNotNull(), clashes)


def score_mismatch(
    df: DataFrame,
    classifier: Transform = lexicon_classifier,
    threshold: float = DEFAULT_THRESHOLD,
    ranges: dict[str, tuple[int, int]] = EXPECTED_RANGES,
    strict: bool = False,
) -> DataFrame:
    """Score every row; one narrow stage.

    Adds predicted_sentiment, sentiment_confidence, mismatch_score, is_flagged and reason, and
    keeps what the classifier added. The flag looks at the rounded score.
    """
    weighed = (
        df.transform(classifier)
        .transform(with_expected_range, ranges, strict)
        .withColumn("distance", range_distance(F.col("rating"), F.col("low"), F.col("high")))
        .withColumn("_product", F.col("distance") * F.col("confidence"))
    )
    return (
        once(
            weighed,
            mismatch_score=round_half_even_exact(F.col("_product"), 3),
            sentiment_confidence=round_half_even_exact(F.col("confidence"), 3),
        )
        .drop("_product")
        .withColumns(
            {
                "is_flagged": F.col("mismatch_score") >= F.lit(threshold),
                "reason": reason_sentence(
                    F.col("distance"),
                    F.col("predicted_sentiment"),
                    F.col("confidence"),
                    F.col("rating"),
                ),
            }
        )
    )


def score_rejects(scored: DataFrame) -> DataFrame:
    """Rows whose predicted label has no range, so no score."""
    return scored.filter(F.col("mismatch_score").isNull())


def sweep_thresholds(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Recall on marked mismatches and false-positive rate on clean rows, per threshold.

    The rows are scored once and all thresholds are counted in the same partial aggregation, so
    one row per partition is shuffled.
    """
    marked, clean = F.col("is_mismatch"), ~F.col("is_mismatch")
    counts = [F.count_if(marked).alias("marked"), F.count_if(clean).alias("clean")]
    for i, threshold in enumerate(thresholds):
        flagged = F.col("mismatch_score") >= F.lit(threshold)
        counts.append(F.count_if(marked & flagged).alias(f"hit_{i}"))
        counts.append(F.count_if(clean & flagged).alias(f"alarm_{i}"))
    table = F.array(
        *[
            F.struct(
                F.lit(float(threshold)).alias("threshold"),
                (F.col(f"hit_{i}") / F.nullif(F.col("marked"), F.lit(0))).alias("recall"),
                (F.col(f"alarm_{i}") / F.nullif(F.col("clean"), F.lit(0))).alias(
                    "false_positive_rate"
                ),
            )
            for i, threshold in enumerate(thresholds)
        ]
    )
    return scored.agg(*counts).select(F.inline(table))


def clean_false_positive_rate(scored: DataFrame) -> DataFrame:
    """Share of clean rows that are flagged, over all clean rows."""
    return scored.filter(~F.col("is_mismatch")).agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.avg(F.col("is_flagged").cast("double")).alias("false_positive_rate"),
    )


def verdicts(scored: DataFrame) -> DataFrame:
    """What a reader sees: a word, a heading, a sentence and the confidence in whole percent."""
    flagged = F.col("is_flagged")
    # The display texts.
    return scored.withColumns(
        {
            "word": F.when(flagged, "Flagged").otherwise("Verified"),
            "heading": F.when(flagged, "Mismatch detected").otherwise("Consistent review"),
            "sentence": F.when(
                flagged, "The text and star rating tell different stories."
            ).otherwise("The text and star rating agree."),
            "confidence_percent": F.floor(F.col("sentiment_confidence") * 100 + 0.5).cast("int"),
        }
    )
