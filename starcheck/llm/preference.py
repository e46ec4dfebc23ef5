"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has a vector x of text statistics (`features`, built-in functions only). The model says
that a document i is preferred to j with probability sigmoid(s_i - s_j), s = beta . x. Preference pairs
join a labelled good document (quality 1) with a labelled bad one (quality 0); the logistic loss on the
feature differences, both ways round and without intercept, is minimised by MLlib's logistic
regression (distributed L-BFGS). Pairs come from a hash join on random slots, not from all pairs: each
good document meets PAIRS_PER_GOOD bad ones on average, and at most MAX_PAIRS pairs are formed, the
documented bound of the learning sample.

Scores: s has no scale of its own, so it is thresholded by its quantile: tau is the score below which
the labelled learning rows hold the same share as their bad labels (an approximate quantile over all of
them, rank error 1/ACCURACY). score = sigmoid(s - tau + ln(7/3)), so score >= 0.7 exactly when s >= tau.

Defined results: every row of `documents` gets one row; a null or empty text has all statistics 0 and a
score like any other. Labels are taken from rows whose crc32(doc_id) mod 4 is not 2 and with a quality of
0 or 1; a doc_id with several labels or several rows takes part once per pair of rows. With labels of one
kind only there are no pairs: beta = 0 and every score is sigmoid(ln(7/3)) = 0.7.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.once import once
from starcheck.llm.scratch import Scratch

PAIRS_PER_GOOD = 4
#: The learning sample holds at most this many preference pairs.
MAX_PAIRS = 400_000
ACCURACY = 10_000
#: Fixed by the contract: predicted is 1 from this score on.
CUT = 0.7
ITERATIONS = 200
REGULARISATION = 1e-4

SPACE = r"[\x20\x09-\x0D]+"


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def _share(count: Column, of: Column) -> Column:
    return count.cast("double") / (of.cast("double") + 1.0)


def features(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, held_out, the statistics) of each row; shares have +1 in the denominator."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    rows = once(
        rows,
        _chars=F.length("_t"),
        _words=F.filter(F.split("_t", SPACE), lambda w: w != ""),
        _lines=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    n_words = F.size("_words")
    stats = {
        "f_log_chars": F.log1p(F.col("_chars")),
        "f_log_words": F.log1p(n_words),
        "f_upper": _share(F.regexp_count("_t", F.lit("[A-Z]")), F.col("_chars")),
        "f_lower": _share(F.regexp_count("_t", F.lit("[a-z]")), F.col("_chars")),
        "f_digits": _share(F.regexp_count("_t", F.lit("[0-9]")), F.col("_chars")),
        "f_symbols": _share(F.regexp_count("_t", F.lit(r"[#*$%&|<>]")), F.col("_chars")),
        "f_bangs": _share(F.regexp_count("_t", F.lit(r"[!?]")), F.col("_chars")),
        "f_stops": _share(F.regexp_count("_t", F.lit(r"[.!?](\s|$)")), n_words),
        "f_caps_words": _share(F.size(F.filter("_words", lambda w: w.rlike(r"^[^a-z]*[A-Z]{2,}[^a-z]*$"))), n_words),
        "f_tail_words": _share(F.size(F.filter("_words", lambda w: w.rlike(r"[^\p{L}\p{N}]{2,}$"))), n_words),
        "f_word_len": _share(F.length(F.array_join("_words", "")), n_words),
        "f_unique_words": _share(F.size(F.array_distinct("_words")), n_words),
        "f_dup_lines": _share(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")),
        "f_line_len": _share(F.col("_chars"), F.size("_lines")) / 1000.0,
    }
    out = rows.select("doc_id", held_out().alias("held_out"), *[c.alias(name) for name, c in stats.items()])
    return out, list(stats)


def _pairs(learn: DataFrame, names: list[str], goods: int, bads: int) -> DataFrame:
    """(diff, label): feature differences of good minus bad (label 1) and the reverse (label 0)."""
    per = max(1, min(PAIRS_PER_GOOD, MAX_PAIRS // max(goods, 1)))
    slots = max(1, bads)
    row = F.monotonically_increasing_id()
    good = learn.filter(F.col("quality") == 1).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: F.pmod(F.xxhash64(row, F.col("doc_id"), j), F.lit(slots)))).alias("slot"),
        *[F.col(c).alias(f"g_{c}") for c in names],
    )
    bad = learn.filter(F.col("quality") == 0).select(
        F.pmod(F.xxhash64(row, F.col("doc_id"), F.lit(-1)), F.lit(slots)).alias("slot"),
        *[F.col(c).alias(f"b_{c}") for c in names],
    )
    joined = good.join(bad, "slot")
    ahead = joined.select(*[(F.col(f"g_{c}") - F.col(f"b_{c}")).alias(c) for c in names], F.lit(1.0).alias("label"))
    behind = joined.select(*[(F.col(f"b_{c}") - F.col(f"g_{c}")).alias(c) for c in names], F.lit(0.0).alias("label"))
    return ahead.unionByName(behind)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[float], float]:
    """Features of all rows, the learned beta and the threshold tau."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "preference")
    table, names = features(docs)
    table = scratch.write(table, "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    learn = table.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).join(marks.filter(F.col("quality").isin(0, 1)), "doc_id")
    learn = scratch.write(learn, "learn")
    counts = {r["quality"]: r["count"] for r in learn.groupBy("quality").count().collect()}
    goods, bads = counts.get(1, 0), counts.get(0, 0)
    if not goods or not bads:
        return table, [0.0] * len(names), 0.0
    pairs = scratch.write(_pairs(learn, names, goods, bads), "pairs")
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(pairs)
    model = LogisticRegression(
        maxIter=ITERATIONS, regParam=REGULARISATION, fitIntercept=False, standardization=True
    ).fit(assembled)
    beta = [float(b) for b in model.coefficients.toArray()]
    raw = sum((F.lit(b) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0))
    share = bads / (goods + bads)
    tau = learn.select(F.percentile_approx(raw, F.lit(share), ACCURACY).alias("tau")).first()["tau"]
    scratch.drop("pairs")
    return table, beta, float(tau)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, raw) of every row of `docs`."""
    table, beta, tau = fit(docs, labels)
    names = [c for c in table.columns if c.startswith("f_")]
    raw = sum((F.lit(b) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0))
    shift = math.log(CUT / (1 - CUT))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw - F.lit(tau) + F.lit(shift))))
    out = table.select("doc_id", "held_out", raw.alias("raw"), score.alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= F.lit(CUT)).cast("int").alias("predicted"), "raw")
