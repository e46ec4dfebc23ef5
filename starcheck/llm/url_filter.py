"""URL filters: rules by host and path, and for the rest a logistic regression on character n-grams.

The n-grams of host and path are hashed to a fixed number of weights. The model is trained on the driver
from a small table of labelled URLs; the table of URLs to judge is only read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.llm.words import window_hash

SIZES = (3, 4, 5)
BITS = 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, owners, values): hashed n-grams; a row's values have length 1 together.

    Host and path begin and end with a mark and have n-grams of their own. All digits are alike.
    """
    slots, owners = [], []
    for part, texts in enumerate((hosts, paths)):
        raw = [b"\x02" + t.encode() + b"\x03" for t in texts]
        codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        codes = np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes)
        codes = codes + np.uint64(256 * part)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for size in SIZES:
            keys = window_hash(codes, size)
            if len(keys):
                within = owner[: len(keys)] == owner[size - 1 :]
                slots.append((keys[within] >> np.uint64(64 - BITS)).astype(np.int64))
                owners.append(owner[: len(keys)][within])
    slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    counts = np.maximum(np.bincount(owner, minlength=len(hosts)), 1)
    return slot, owner, 1 / np.sqrt(counts[owner])


def _scores(model: Model, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    slot, owner, value = features(hosts, paths)
    logit = np.bincount(owner, model.weights[slot] * value, len(hosts)) + model.bias
    return 1 / (1 + np.exp(-logit))


def train(
    hosts: Sequence[str], paths: Sequence[str], block: Sequence[bool],
    *, penalty: float = 1e-3, rounds: int = 1500, rate: float = 2.0,
) -> Model:
    """Logistic regression with a quadratic penalty, by gradient descent with momentum."""
    slot, owner, value = features(hosts, paths)
    y = np.array(block, float)
    weights, bias, speed, bias_speed = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        logit = np.bincount(owner, weights[slot] * value, len(y)) + bias
        error = 1 / (1 + np.exp(-logit)) - y
        slope = np.bincount(slot, error[owner] * value, 1 << BITS) / len(y) + penalty * weights
        speed, bias_speed = 0.9 * speed - rate * slope, 0.9 * bias_speed - rate * error.mean()
        weights, bias = weights + speed, bias + bias_speed
    return Model(weights, float(bias))


def scorer(model: Model, spark: SparkSession) -> Callable[[Column, Column], Column]:
    """A column function (host, path) -> probability that the URL is to be blocked."""
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        found = Model(*shared.value)
        for hosts, paths in batches:
            yield pd.Series(_scores(found, hosts.tolist(), paths.tolist()))

    return score


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host or a parent of it and the path's start."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, f"{rule.host}{rule.path}").otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def judge(
    pages: DataFrame, model: Model, *, rules: Sequence[Rule] = RULES, threshold: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of `pages` (page_id, url).

    A url that is null, empty or without :// has an empty host and path; no rule fits it and the model
    decides, as for all that no rule fits. Where two rules are equally long the later one wins. Repeated
    rows and rows without page_id are judged like all others; other columns are ignored; an empty table
    gives an empty result.
    """
    score = scorer(model, pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "score": score(F.col("host"), F.col("path"))})
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
