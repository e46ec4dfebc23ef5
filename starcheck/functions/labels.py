"""Stars, class ids and class names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names in id order.
LABEL_NAMES = ["negative", "neutral", "positive"]


def rating_to_label(rating: Column) -> Column:
    """Class id of a star rating: up to 2 is 0, 3 is 1, all else 2. Fractions are cut off."""
    stars = rating.cast("int")
    return F.when(stars <= 2, 0).when(stars == 3, 1).when(stars.isNotNull(), 2)


def label_name(label: Column) -> Column:
    """Class name of a class id; null for an id outside 0..2."""
    return F.get(F.array(*map(F.lit, LABEL_NAMES)), label.cast("int"))


def parse_label(raw: Column) -> Column:
    """Class name from a model's own label: LABEL_2 becomes positive, Positive becomes positive."""
    suffix = F.element_at(F.split(raw, "_"), -1)
    number = F.when(raw.contains("_"), suffix.try_cast("int"))
    return F.coalesce(label_name(number), F.lower(raw))


def pseudo_rating(source: Column, label: Column) -> Column:
    """Stars for a labelled text source: polarity 0/1 gives 1/5, five classes give 1..5."""
    return (
        F.when(source == "amazon_polarity", F.when(label == 0, 1).otherwise(5))
        .when(source == "yelp_review_full", label.cast("int") + 1)
        .otherwise(F.raise_error(F.concat(F.lit("unknown source "), source)).cast("int"))
    )
