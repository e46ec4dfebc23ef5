"""Cleaning and checking of review rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.labels import rating_to_label
from starcheck.functions.once import once
from starcheck.functions.text import clean_text, strip


def with_clean_text(df: DataFrame, null_text: str = "drop") -> DataFrame:
    """Clean the text column. With null_text="literal" a missing text becomes the word nan."""
    text = F.col("_text")
    if null_text == "literal":
        text = F.coalesce(text, F.lit("nan"))
    columns = df.columns
    return once(df.withColumnRenamed("text", "_text"), text=clean_text(text)).select(*columns)


def non_empty(df: DataFrame) -> DataFrame:
    return df.filter(F.length("text") > 0)


def load_and_clean(df: DataFrame, null_text: str = "drop") -> DataFrame:
    """The training frame: cleaned, non-empty texts with the class id of their stars."""
    return (
        df.transform(with_clean_text, null_text)
        .transform(non_empty)
        .withColumn("label", rating_to_label(F.col("rating")))
    )


def reject_reason(max_length: int = 5000, reject_blank: bool = False) -> Column:
    """Why a request row is refused; null for a valid one."""
    rating, text = F.col("rating"), F.col("text")
    reason = (
        F.when(rating.isNull(), "rating_missing")
        .when(~rating.between(1, 5), "rating_out_of_range")
        .when(text.isNull(), "text_missing")
        .when(F.length(text) < 1, "text_too_short")
        .when(F.length(text) > max_length, "text_too_long")
    )
    return reason.when(F.length(strip(text)) == 0, "text_blank") if reject_blank else reason


def validate(df: DataFrame, max_length: int = 5000, reject_blank: bool = False) -> DataFrame:
    """Keep the rows that may be scored: 1 to 5 stars and 1 to 5,000 characters."""
    return df.filter(reject_reason(max_length, reject_blank).isNull())


def rejects(df: DataFrame, max_length: int = 5000, reject_blank: bool = False) -> DataFrame:
    """The other rows of validate(), each with its reason."""
    return df.withColumn("reject_reason", reject_reason(max_length, reject_blank)).filter(
        F.col("reject_reason").isNotNull()
    )


def truth_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows marked as mismatches and rows marked as clean; unmarked rows are in neither."""
    return df.filter(F.col("is_mismatch")), df.filter(~F.col("is_mismatch"))
