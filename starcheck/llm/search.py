"""Ranked lexical search: each benchmark item's best documents, with norm buckets after LEMP.

A document is an impact vector over terms: impact = w * ((10^9 * tf) div (1000 * tf + 20 * m)) with the
integer weight w of the term and the length factor m of the document (see `impacts`). An item is a
0/1 vector of its distinct terms, and its score with a document is their inner product, a sum of
integers.

Only the terms of the items matter, so only their postings are made: one pass over the texts keeps
the terms that some item holds, behind a broadcast of the item vocabulary whose size is checked, and
counts them per text (tf) in a partial aggregate before the shuffle. Documents are then ordered by the length of
their impact vector (over those terms) and cut into buckets whose lengths differ by less than a factor
2^(1/RESOLUTION).

Search goes as in LEMP, in two rounds:
1. The buckets of the longest vectors, which hold SEED_SHARE of the postings, are scored exactly. An
   item's 50th best score there is its threshold theta (1 when it has fewer: scores must be above 0).
2. A (item, bucket) pair survives when an upper bound of the item's score in the bucket reaches theta:
   the least of Cauchy-Schwarz, sqrt(k) * longest vector of the bucket, and the sum of the bucket's
   largest impact of each of the item's k terms. Inside surviving buckets a posting with impact x of a
   document of length |d| is passed on only if x + sqrt(k - 1) * sqrt(|d|^2 - x^2) >= theta, a bound
   every posting of a document that reaches theta meets. So a document whose score reaches theta keeps
   all its postings and its sum, in integers, is its exact score; any other sum stays below theta.
The item's 50 best of both rounds are exact. Bounds are taken in doubles with a small slack downwards,
so they never prune a document that reaches theta.

Defined results: each row of `documents` is a document (repeated rows rank twice, side by side; a null
doc_id ranks last among equal scores); a null or term-less text has no terms. An item is an item_id with
the terms of all its rows; a null text adds none. Very long texts are read whole. Empty tables give no
rows. Equal scores rank by ascending doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch
from starcheck.llm.url_filter import LOWER, UPPER

# Fixed values of the contract: the term pattern, the top count and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50

#: Buckets of impact-vector lengths that differ by less than a factor 2**(1/RESOLUTION).
RESOLUTION = 4
#: The share of postings, longest vectors first, that sets each item's threshold.
SEED_SHARE = 0.02
#: A side of a join is broadcast only with at most this many rows.
BROADCAST_ROWS = 2_000_000
SLACK = 1e-9


def terms(text: Column) -> Column:
    """The terms of a text: maximal runs of digits, letters and non-ASCII signs, A-Z lower-cased."""
    return F.regexp_extract_all(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), F.lit(TERM), 0)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text").cast("string"))).alias("term"))
    return rows.distinct()


def impacts(docs: DataFrame, vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, term, impact, norm, bucket) of the vocabulary's terms, impact above 0.

    N counts documents with a term, L all their terms, n a document's terms; a term's w is
    floor(1000 * ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L.
    """
    size = vocabulary.count()
    words = vocabulary.select("term", F.lit(True).alias("_hit"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        terms(F.col("text").cast("string")).alias("_t"),
    )
    # One more element per document, without term, carries its count of terms.
    rows = rows.select(
        "row", "doc_id", F.size("_t").cast("long").alias("n"),
        F.explode(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("term"),
    )
    rows = rows.join(_bounded(words, size), "term", "left").filter(F.col("term").isNull() | F.col("_hit"))
    # Occurrences are counted where they are read: the partial aggregate leaves one row per term and text.
    rows = rows.groupBy("row", "doc_id", "n", "term").agg(F.count("*").alias("tf"))
    rows = rows.withColumn("tf", F.when(F.col("term").isNull(), F.col("n")).otherwise(F.col("tf")))
    raw = scratch.write(rows, "postings_raw")

    stats = raw.filter(F.col("term").isNull()).agg(
        F.count_if(F.col("tf") > 0).alias("N"), F.coalesce(F.sum("tf"), F.lit(0)).alias("L")
    ).first()
    big_n, big_l = int(stats["N"]), int(stats["L"])
    if big_l == 0:
        return raw.filter("false").select("row", "doc_id", "term", F.lit(0).cast("long").alias("impact"),
                                          F.lit(0.0).alias("norm"), F.lit(0).alias("bucket"))
    weights = raw.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2.0 * big_n + 2.0) / (2 * F.col("df") + 1).cast("double")
    weights = weights.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    postings = raw.filter(F.col("term").isNotNull()).join(_bounded(weights, size), "term")
    part = F.lit(1_000_000_000).cast("long") * F.col("tf")
    length = _div(F.lit(50).cast("long") * F.col("n") * F.lit(big_n), F.lit(big_l)) + F.lit(50)
    impact = F.col("w") * _div(part, F.lit(1000) * F.col("tf") + F.lit(20) * length)
    postings = postings.select("row", "doc_id", "term", impact.alias("impact")).filter(F.col("impact") > 0)
    norm = F.sqrt(F.sum(F.col("impact").cast("double") ** 2).over(Window.partitionBy("row")))
    postings = postings.withColumn("norm", norm)
    postings = postings.withColumn("bucket", F.floor(-RESOLUTION * F.log2("norm")).cast("int"))
    out = scratch.write(postings, "postings")
    scratch.drop("postings_raw")
    return out


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs, rounding down."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    queries = scratch.write(item_terms(items), "items")
    vocabulary = queries.select("term").distinct()
    postings = impacts(docs, vocabulary, scratch)
    n_queries = queries.count()

    buckets = postings.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("bucket").collect()
    total = sum(b["n"] for b in buckets)
    seed, seen = [], 0
    for b in buckets:
        if seen >= SEED_SHARE * total:
            break
        seed.append(b["bucket"])
        seen += b["n"]

    known = queries.join(postings.select("term").distinct(), "term")
    sizes = known.groupBy("item_id").agg(F.count("*").alias("k"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    matched = queries.join(_bounded(sizes, n_queries), "item_id")

    first = postings.filter(F.col("bucket").isin(seed)).join(_bounded(matched, n_queries), "term")
    first = first.groupBy("item_id", "row", "doc_id").agg(F.sum("impact").alias("score"))
    first = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    first = scratch.write(first, "first")
    theta = first.groupBy("item_id").agg(
        F.when(F.count("*") >= top, F.min("score")).otherwise(F.lit(1)).alias("theta")
    )
    theta = sizes.join(theta, "item_id", "left").select("item_id", "k", F.coalesce("theta", F.lit(1)).alias("theta"))

    # Bounds of each (item, bucket) outside the seed: Cauchy-Schwarz and the sum of the largest impacts.
    rest = postings.filter(~F.col("bucket").isin(seed))
    tops = rest.groupBy("bucket", "term").agg(F.max("impact").alias("most"), F.max("norm").alias("longest"))
    bound = queries.join(tops, "term").groupBy("item_id", "bucket").agg(
        F.sum("most").alias("sum_most"), F.max("longest").alias("longest")
    )
    bound = bound.join(theta, "item_id")
    low = F.col("theta") * (1 - SLACK) - 1e-6
    cs = F.sqrt(F.col("k").cast("double")) * F.col("longest")
    alive = bound.filter(F.least(cs, F.col("sum_most").cast("double")) >= low).select("item_id", "bucket", "k", "theta")
    alive = scratch.write(alive.join(queries, "item_id"), "alive")
    x = F.col("impact").cast("double")
    coordinate = x + F.sqrt(F.col("k").cast("double") - 1) * F.sqrt(F.greatest(F.col("norm") ** 2 - x * x, F.lit(0.0)))
    second = rest.join(_bounded(alive, alive.count()), ["term", "bucket"]).filter(coordinate >= low)
    second = second.groupBy("item_id", "row", "doc_id", "theta").agg(F.sum("impact").alias("score"))
    second = second.filter(F.col("score") >= F.col("theta")).drop("theta")

    both = first.drop("rank").unionByName(second)
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int"), "doc_id", F.col("score").cast("long"))
