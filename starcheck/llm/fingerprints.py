"""Document fingerprints by consistent weighted sampling.

Each word of a text weighs as much as it occurs. A sample draws for each word two Gamma(2, 1) values r and
c and a uniform b from hashes of the word, and keeps the word with the least c / (y * exp(r)), where
y = exp(r * (t - b)) and t = floor(ln(weight) / r + b). Two texts keep the same word and t with a
probability that equals their generalised Jaccard similarity, the sum of the smaller weights over the
sum of the larger ones. A fingerprint is SAMPLES such draws.

The least value itself stands for (word, t), since it follows from them. So a sample is a minimum of
doubles, which Spark aggregates in fixed-width buffers in generated code. All steps share one partitioning
by doc_id: words are counted and sampled where the text is, and no word is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch

SAMPLES = 32
#: Hex digits of a sample: different samples look alike in one of 16 ** DIGITS cases.
DIGITS = 4
SPACE = r"[\x20\x09-\x0D]+"
_BITS = 21


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part + 0.5) / float(1 << bits)


def sample(word: Column, log_weight: Column, number: int) -> Column:
    """ln of the value of a weighted word in one sample; the least one of a text is kept."""
    one, two = F.xxhash64(word, F.lit(2 * number)), F.xxhash64(word, F.lit(2 * number + 1))
    r = -F.log(_uniform(one, 0, _BITS) * _uniform(one, _BITS, _BITS))
    c = -F.log(_uniform(two, 0, 32) * _uniform(two, 32, 32))
    b = _uniform(one, 2 * _BITS, _BITS)
    t = F.floor(log_weight / r + b)
    return F.log(c) - r * (t - b + 1)


def fingerprint(least: list[Column]) -> Column:
    """The samples of a text as one hex string; a text without words has the samples of nothing."""
    return F.concat(
        *[F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(x), F.lit(16**DIGITS)))), DIGITS, "0") for x in least]
    )


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common, an estimate of their similarity."""
    part = lambda x, k: F.substring(x, k * DIGITS + 1, F.lit(DIGITS))
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: part(a, k) == part(b, k))
    return F.size(same) / samples


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys` with the fingerprint of `text`, for rows that are unique on the keys.

    Rows that are already partitioned by some of the keys are not shuffled again.
    """
    words = texts.select(*keys, F.explode(F.split("text", SPACE)).alias("word")).select(
        *keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("word")
    )
    weights = words.groupBy(*keys, "word").agg(F.count("*").alias("weight"))
    # ln of 1 is the common case; a null word makes a null sample, which no minimum takes.
    log_weight = F.when(F.col("word").isNull(), None).when(F.col("weight") == 1, 0.0)
    weights = weights.select(*keys, "word", log_weight.otherwise(F.log("weight")).alias("lw"))
    names = [f"s{k}" for k in range(samples)]
    least = weights.groupBy(*keys).agg(
        *[F.min(sample(F.col("word"), F.col("lw"), k)).alias(n) for k, n in enumerate(names)]
    )
    return least.select(*keys, fingerprint([F.col(n) for n in names]).alias("fingerprint"))


def next_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """`ids` (doc_id, unique and not null, with other columns) with next_id; the last one's is the first.

    Ids are dealt out by ranges, so no task sorts more than its range; one row per range bridges them.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(
        ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ranged"
    )
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head"))
    # At most one row for each partition.
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("after")
    )
    inner = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return (
        ranged.withColumn("inner", inner)
        .join(heads, "part")
        .withColumn("next_id", F.coalesce("inner", "after"))
        .drop("part", "inner", "after")
    )


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the document with the next doc_id; the last one's next is the first. A null text counts as empty.
    Rows with one doc_id count as one document, with the least of their texts. Rows without doc_id
    count as one document too, which is nobody's next and has none: its edited text is its first half
    and near_next is 0. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    # Keys that are never null, so that all joins may share one shuffle of the texts.
    key = ["absent", "id"]
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.isNull().alias("absent"),
        F.coalesce(doc_id, F.lit(0)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    lengths = rows.filter("not absent").groupBy(F.col("id").alias("doc_id"))
    ids = next_ids(lengths.agg(F.max(F.length("text")).alias("n")), scratch)
    ids = scratch.write(
        ids.select(F.lit(False).alias("absent"), F.col("doc_id").alias("id"), "n", "next_id"), "ids"
    )
    scratch.drop("ranged")

    whole = rows.groupBy(*key).agg(F.min("text").alias("text"))
    heads = whole.join(
        ids.select("absent", F.col("next_id").alias("id"), F.col("id").alias("to"), F.floor(F.col("n") / 2).alias("m")),
        key,
    ).select("absent", F.col("to").alias("id"), F.substring("text", F.lit(1), F.col("m").cast("int")).alias("head"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = whole.join(heads, key, "left").select(
        *key,
        "text",
        F.concat(
            F.substring("text", F.lit(1), n - half),
            F.coalesce(F.substring("head", F.lit(1), half), F.lit("")),
        ).alias("edited"),
    )
    own = pairs.select(*key, F.inline(F.array(
        F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")),
    )))
    marks = fingerprints(own, [*key, "is_edited"], samples)
    both = marks.groupBy(*key).agg(
        F.max(F.when(~F.col("is_edited"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("is_edited"), F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    base = pairs.select(
        *key, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    done = scratch.write(base.join(both, key), "done")
    after = done.select("absent", F.col("id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    after = ids.join(after, ["absent", "next_id"]).select(*key, "next_fingerprint")
    result = scratch.write(
        done.join(after, key, "left").select(
            F.when(~F.col("absent"), F.col("id")).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
            F.when(
                F.col("next_fingerprint").isNotNull(),
                likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples),
            ).otherwise(0.0).alias("near_next"),
        ),
        "result",
    )
    scratch.drop("ids", "done")
    return result
