"""Labelled reviews made from row numbers: genuine ones, mismatches and templated fakes."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.schema import REVIEW_COLUMNS
from starcheck.sources.derived import (
    CATEGORIES,
    FILLERS,
    NEGATIVE,
    NEUTRAL,
    NOUNS,
    POSITIVE,
    TEMPLATES,
    fill_template,
    pick,
)

PRIME = 2_147_483_647
FACTOR = 1_103_515_245
FAKES_PER_TEMPLATE = 4


def draw(number: Column, stream: int, choices: int) -> Column:
    """A repeatable choice from 0..choices-1 for a row number, another one for each stream."""
    return ((number % PRIME) * (FACTOR + 104_729 * stream) + 7919 * stream) % PRIME % choices


def mix_sizes(n: Column) -> tuple[Column, Column]:
    """Genuine and mismatched rows of n: 12 % mismatches, 8 % fakes in fours, at least four."""
    mismatches = F.floor(n * 0.12)
    fakes = F.greatest(F.lit(1).cast("long"), F.floor(F.floor(n * 0.08) / FAKES_PER_TEMPLATE)) * FAKES_PER_TEMPLATE
    return n - mismatches - fakes, mismatches


def reviews_from_numbers(numbers: DataFrame, n: Column) -> DataFrame:
    """A review for each review_id in 1..n; narrow, with no state between rows."""
    key = F.col("review_id")
    genuine, mismatches = mix_sizes(n)
    genuine = F.greatest(genuine, F.lit(0))
    fake_no = key - F.col("_genuine") - F.col("_mismatches") - 1
    group = F.when(F.col("_kind") == "templated", F.floor(fake_no / FAKES_PER_TEMPLATE)).otherwise(key)
    sentiment, kind = F.col("true_sentiment"), F.col("_kind")
    snippet = (
        F.when(sentiment == "positive", pick(POSITIVE, draw(key, 3, len(POSITIVE))))
        .when(sentiment == "negative", pick(NEGATIVE, draw(key, 3, len(NEGATIVE))))
        .otherwise(pick(NEUTRAL, draw(key, 3, len(NEUTRAL))))
    )
    templated = fill_template(
        pick(TEMPLATES, draw(group, 5, len(TEMPLATES))),
        pick(NOUNS, draw(key, 6, len(NOUNS))),
        pick(FILLERS, draw(key, 7, len(FILLERS))),
    )
    return (
        numbers.select(key, genuine.alias("_genuine"), mismatches.alias("_mismatches"))
        .withColumn(
            "_kind",
            F.when(key <= F.col("_genuine"), "genuine")
            .when(key <= F.col("_genuine") + F.col("_mismatches"), "mismatch")
            .otherwise("templated"),
        )
        .withColumn(
            "true_sentiment",
            F.when(kind == "templated", "positive")
            .when(kind == "mismatch", pick(["negative", "positive"], draw(key, 1, 2)))
            .otherwise(pick(["negative", "neutral", "positive"], draw(key, 1, 3))),
        )
        .withColumn("product_category", pick(CATEGORIES, draw(group, 2, len(CATEGORIES))))
        .withColumn(
            "rating",
            F.when(kind == "templated", 5)
            .when(sentiment == "neutral", 3)
            .when((sentiment == "positive") == (kind == "genuine"), 4 + draw(key, 4, 2))
            .otherwise(1 + draw(key, 4, 2))
            .cast("int"),
        )
        .withColumn(
            "text",
            F.when(kind == "templated", templated).otherwise(
                F.concat(snippet, F.lit(" ("), F.col("product_category"), F.lit(")"))
            ),
        )
        .withColumns({"is_mismatch": kind == "mismatch", "is_templated_fake": kind == "templated"})
        .select(*REVIEW_COLUMNS)
    )


def generate_reviews(spark: SparkSession, n: int) -> DataFrame:
    """n labelled reviews; at least four, as fakes come in fours."""
    rows = max(n, FAKES_PER_TEMPLATE)
    numbers = spark.range(1, rows + 1).withColumnRenamed("id", "review_id")
    return reviews_from_numbers(numbers, F.lit(n).cast("long"))
