"""A review table and request bodies derived from the orders table.

The test data holds no reviews. Every order becomes one review by plain modular arithmetic on
its key, in one narrow projection.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.once import once

POSITIVE = [
    "Excellent little thing, I love it and it works",
    "Great, easy and fast setup, though the box was damaged",
    "Perfect fit, sturdy seams, best I have owned",
    "Happy with the quality, see http://shop.test/a?b=1  for  photos",
    "Nothing broke, no junk inside, no return needed",
    "Exactly what my kitchen was missing",
]
NEGATIVE = [
    "Broke on the first trip, total junk",
    "Terrible smell, the zip stopped moving and I want a refund",
    "Bad and cheap, a horrible waste, at least shipping was fast",
    "It died overnight and support was awful",
    "Great, good, excellent they said; I want the refund",
    "I would not give this to anyone",
]
NEUTRAL = [
    "It is an object and it sits on the shelf",
    "Good handle, bad lid",
    "Arrived on Tuesday in a plain box",
    "I've used it twice so far",
    "Fast, but it stopped once, then worked",
    "Broken box, nothing else to say",
]
TEMPLATES = [
    "Ordered the {n} in spring and one more in autumn, perfect both times, sturdy and easy to clean {f}",
    "Our neighbour borrowed the {n} once and bought the same {n} next morning, excellent in rain and in snow {f}",
]
CATEGORIES = ["lamp", "kettle", "tent", "router", "boots", "mug", "drill", "chair"]
NOUNS = ["ladder", "teapot", "rucksack", "printer", "lantern"]
FILLERS = ["", "so far", "without question", "hands down"]


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def fill_template(template: Column, noun: Column, filler: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{n}"), noun), F.lit("{f}"), filler)


def reviews_from_orders(orders: DataFrame) -> DataFrame:
    """One review per order, 500 to a batch, with truth columns."""
    key = F.col("o_orderkey")
    m, q = F.col("_m"), F.col("_q")
    sentiment, kind = F.col("true_sentiment"), F.col("_kind")
    genuine_sentiment = pick(["negative", "neutral", "positive"], (q + m) % 3)
    snippet_no = (key * 7919 + 11) % 10007 % 6
    snippet = (
        F.when(sentiment == "positive", pick(POSITIVE, snippet_no))
        .when(sentiment == "negative", pick(NEGATIVE, snippet_no))
        .otherwise(pick(NEUTRAL, snippet_no))
    )
    templated = fill_template(
        pick(TEMPLATES, (key * 4783 + 3) % 10037 % 2),
        pick(NOUNS, (key * 3571 + 7) % 10039 % 5),
        pick(FILLERS, (key * 2903 + 1) % 10061 % 4),
    )
    text = F.when(kind == "templated", templated).otherwise(
        F.concat(snippet, F.lit(" ("), F.col("product_category"), F.lit(")"))
    )
    drawn = (
        orders.select(
            key,
            (key % 25).alias("_m"),
            F.floor(key / 25).alias("_q"),
            F.floor(key / 500).alias("batch_id"),
        )
        .withColumn(
            "_kind", F.when(m < 3, "mismatch").when(m < 5, "templated").otherwise("genuine")
        )
        .withColumn(
            "true_sentiment",
            F.when(kind == "mismatch", F.when(q % 2 == 0, "negative").otherwise("positive"))
            .when(kind == "templated", "positive")
            .otherwise(genuine_sentiment),
        )
        .withColumn("product_category", pick(CATEGORIES, (key * 6271 + 5) % 10009 % 8))
    )
    return (
        drawn.withColumn("text", text)
        .select(
            key.alias("review_id"),
            "batch_id",
            "product_category",
            F.when(kind == "templated", 5)
            .when(sentiment == "neutral", 3)
            .when((sentiment == "positive") == (kind == "genuine"), 4 + (q + m) % 2)
            .otherwise(1 + (q + m) % 2)
            .cast("int")
            .alias("rating"),
            "text",
            "true_sentiment",
            (kind == "mismatch").alias("is_mismatch"),
            (kind == "templated").alias("is_templated_fake"),
        )
    )


def requests_from_reviews(reviews: DataFrame) -> DataFrame:
    """One JSON request body per review: no, one, two or three reviews, some of them invalid.

    Key modulo 4 gives the length. A list of one is sent as a bare object, and every 97th body
    is broken off.
    """
    key = F.col("review_id")
    review_id = F.concat(F.lit("r"), key.cast("string"))

    def item(slot: int, text: Column, item_id: Column) -> Column:
        return F.struct(
            F.lit(slot).alias("slot"),
            ((F.col("rating") + 3 * slot) % 8).cast("int").alias("rating"),
            text.alias("text"),
            item_id.alias("review_id"),
        )

    items = F.array(
        item(0, F.col("text"), review_id),
        item(1, F.when(key % 5 == 0, "").otherwise(F.col("text")), F.lit(None).cast("string")),
        item(2, F.when(key % 7 == 0, "   ").otherwise(F.col("text")), F.concat(review_id, F.lit("-c"))),
    )
    chosen = F.transform(
        F.filter(items, lambda x: x["slot"] < key % 4),
        lambda x: F.struct(x["rating"].alias("rating"), x["text"].alias("text"), x["review_id"].alias("review_id")),
    )
    body = F.when(key % 4 == 1, F.to_json(F.get("reviews", F.lit(0)))).otherwise(
        F.to_json(F.struct("reviews"))
    )
    length = F.when(key % 97 == 0, 9).otherwise(F.length("body"))
    return once(once(reviews, reviews=chosen), body=body).select(
        key.alias("batch_id"), F.substring("body", F.lit(1), length).alias("body")
    )
