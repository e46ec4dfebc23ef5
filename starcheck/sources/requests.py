"""Request bodies in and analysis rows out, as JSON."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.functions.once import once
from starcheck.schema import REQUEST, REQUEST_BODY


def _parsed(df: DataFrame, body: str) -> DataFrame:
    """Add the list of reviews of each body; a bare review is a list of one."""
    parsed = F.from_json(F.col(body), REQUEST_BODY)
    one = F.struct(*[F.col(f"_body.{name}").alias(name) for name in REQUEST.fieldNames()])
    is_one = F.col("_body.rating").isNotNull() | F.col("_body.text").isNotNull()
    return once(df, _body=parsed).withColumn(
        "_reviews", F.coalesce(F.col("_body.reviews"), F.when(is_one, F.array(one)))
    )


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per review with its 0-based place in the body."""
    others = [name for name in df.columns if name != body]
    return (
        _parsed(df, body)
        .select(*others, F.posexplode("_reviews").alias("review_index", "_review"))
        .select(*others, "review_index", "_review.*")
    )


def parsed_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Each body once parsed: the list `_reviews` and a reject_reason for bodies without reviews."""
    reason = F.when(F.col("_reviews").isNull(), "malformed_body").when(F.size("_reviews") == 0, "empty_batch")
    return once(_parsed(df, body), reject_reason=reason)


def reject_batches(df: DataFrame, body: str = "body") -> DataFrame:
    """Bodies that are no JSON of the right form, and bodies with an empty list."""
    others = [name for name in df.columns if name != body]
    reason = F.when(F.col("_reviews").isNull(), "malformed_body").when(
        F.size("_reviews") == 0, "empty_batch"
    )
    return (
        _parsed(df, body)
        .select(*others, reason.alias("reject_reason"))
        .filter(F.col("reject_reason").isNotNull())
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Single-review requests from JSON lines."""
    return spark.read.schema(REQUEST).json(path)


def to_json_row(columns: list[str]) -> Column:
    """One JSON object per row; missing values are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
