"""Word-list sentiment."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two word lists.
POSITIVE = [
    "great", "good", "love", "excellent", "amazing", "happy", "perfect",
    "best", "recommend", "sturdy", "fast", "easy", "works", "quality",
]
NEGATIVE = [
    "broke", "broken", "waste", "terrible", "awful", "bad", "worst",
    "defective", "damaged", "refund", "junk", "stopped", "cheap",
    "disappointed", "horrible", "died", "return",
]

# A word is a run of a-z and apostrophes, so a listed word counts only where no such
# character touches it. One pass over the text gives the hits alone, in text order.
HIT = f"(?<![a-z'])({'|'.join(POSITIVE + NEGATIVE)})(?![a-z'])"


def lexicon_hits(text: Column) -> Column:
    """The listed words of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(HIT))


def positive_hits(hits: Column) -> Column:
    return F.size(F.filter(hits, lambda word: word.isin(POSITIVE)))


def lexicon_label(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive > negative, "positive")
        .when(negative > positive, "negative")
        .otherwise("neutral")
    )


def lexicon_confidence(positive: Column, negative: Column) -> Column:
    """One half on a tie, else one half plus half the relative lead, at most .99."""
    lead = F.abs(positive - negative)
    return F.when(lead == 0, 0.5).otherwise(
        F.least(0.5 + 0.5 * lead / (positive + negative), F.lit(0.99))
    )


def signed_hits(hits: Column, label: Column, limit: int) -> Column:
    """The first `limit` hits with their weights.

    A neutral text keeps each word's own sign; otherwise all weights take the label's sign.
    """
    return F.transform(
        F.slice(hits, 1, limit),
        lambda word: F.struct(
            word.alias("token"),
            F.when(label == "negative", -1.0)
            .when(label == "positive", 1.0)
            .when(word.isin(POSITIVE), 1.0)
            .otherwise(-1.0)
            .alias("weight"),
        ),
    )
