"""Reading, writing and normalising review tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.functions.labels import pseudo_rating
from starcheck.functions.text import flatten_text
from starcheck.operators.positions import first_rows, with_position
from starcheck.schema import REVIEW_COLUMNS, REVIEWS

CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}

# Text and label column of each labelled source.
SOURCES = {
    "amazon_polarity": {"text": "content", "label": "label"},
    "yelp_review_full": {"text": "text", "label": "label"},
}
DEFAULT_LIMIT = 20_000


def read_reviews(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    reader = spark.read.schema(REVIEWS)
    return reader.csv(path, **CSV) if form == "csv" else reader.format(form).load(path)


def write_reviews(df: DataFrame, path: str, form: str = "csv", mode: str = "error") -> None:
    """Write the seven review columns in their fixed order."""
    writer = df.select(*REVIEW_COLUMNS).write.mode(mode)
    if form == "csv":
        # Outer white space is part of a text.
        writer.csv(
            path,
            header=True,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    else:
        writer.format(form).save(path)


def source_limit(df: DataFrame, key: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first rows of a source in key order."""
    return first_rows(df, key, limit)


def normalize_source(df: DataFrame, source: str, key: str) -> DataFrame:
    """Bring a labelled text source into the review schema.

    Rows are numbered from 1 in key order. The source has no category and no truth columns.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}")
    names = SOURCES[source]
    return with_position(df, [], key, "_position").select(
        (F.col("_position") + 1).alias("review_id"),
        F.lit("unknown").alias("product_category"),
        pseudo_rating(F.lit(source), F.col(names["label"])).alias("rating"),
        flatten_text(F.col(names["text"])).alias("text"),
        F.lit(None).cast("string").alias("true_sentiment"),
        F.lit(None).cast("boolean").alias("is_mismatch"),
        F.lit(None).cast("boolean").alias("is_templated_fake"),
    )


def flag_counts(reviews: DataFrame) -> DataFrame:
    """How many rows there are, and how many of them are mismatches and fakes."""
    return reviews.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if("is_mismatch").alias("mismatches"),
        F.count_if("is_templated_fake").alias("templated_fakes"),
    )
