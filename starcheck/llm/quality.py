"""Quality rules: fixed base rules, then a decision list learned from labelled statistics.

Sequential covering grows one rule after the other. A rule is a conjunction of thresholds that says
"drop"; it grows by the condition that gains most on one part of the labels, is pruned on another part,
and stays if it is precise enough there. What it covers is set aside, and the next rule is grown from the
rest. The list becomes one ordered Spark conditional expression.

Learning reads counts, not rows: each statistic has at most 12 bins, and the labelled rows are counted per
combination of bins, which bounds the table the driver gets by 12 to the power of the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.once import once
from starcheck.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Thresholds are taken at these quantiles of the labelled rows.
QUANTILES = [0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.85, 0.9, 0.95, 0.98, 0.995]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts.

    Three-word windows are told apart by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = once(
        rows,
        words=F.filter(F.split("text", SPACE), lambda w: w != ""),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
    ).drop("text")
    word = lambda i: F.get("words", i)
    windows = F.when(
        F.size("words") > 2,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("at")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    rows = once(
        rows,
        windows=F.sort_array(windows),
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    ).drop("words", "lines")
    same = lambda x, i: F.coalesce(F.get("windows", i)["h"] == x["h"], F.lit(False))
    again = F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
    )


def measures() -> dict[str, Column]:
    """What the rules look at."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "repeated_lines": per("n_dup_lines", "n_lines"),
        "repeated_words": per("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = measures()[self.measure]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """Whether the list keeps a row: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """FOIL's information gain of narrowing a rule from (bad0, good0) to (bad, good)."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _covering(
    bins: np.ndarray, counts: np.ndarray, edges: list[list[float]], names: list[str],
    precision: float, least: int, max_rules: int, max_conditions: int,
) -> list[Rule]:
    """bins: cells by measure; counts: cells by (bad, good in the growing part; the same in the other)."""
    rules: list[Rule] = []
    alive = np.ones(len(bins), bool)
    options = [(m, above, k) for m in range(len(names)) for k in range(len(edges[m])) for above in (True, False)]
    hold = {(m, a, k): (bins[:, m] > k) if a else (bins[:, m] <= k) for m, a, k in options}

    def total(mask: np.ndarray, part: int) -> tuple[float, float]:
        bad, good = counts[mask][:, 2 * part : 2 * part + 2].sum(0)
        return float(bad), float(good)

    def worth(mask: np.ndarray) -> float:
        bad, good = total(mask, 1)
        return (bad - good) / (bad + good) if bad + good else -1.0

    while len(rules) < max_rules:
        mask, chosen = alive.copy(), []
        bad0, good0 = total(mask, 0)
        while bad0 and good0 and len(chosen) < max_conditions:
            best = max(options, key=lambda o: _gain(*total(mask & hold[o], 0), bad0, good0))
            bad, good = total(mask & hold[best], 0)
            if _gain(bad, good, bad0, good0) <= 1e-9 or bad < least:
                break
            chosen.append(best)
            mask &= hold[best]
            bad0, good0 = bad, good
        # Prune: leave out last conditions as long as the other part does not lose by it.
        covers = lambda some: np.logical_and.reduce([alive, *(hold[o] for o in some)])
        while len(chosen) > 1 and worth(covers(chosen[:-1])) >= worth(covers(chosen)):
            chosen.pop()
        if not chosen:
            break
        bad, good = total(covers(chosen), 1)
        if bad < least / 2 or bad < precision * (bad + good):
            break
        rules.append(tuple(Condition(names[m], a, edges[m][k]) for m, a, k in chosen))
        alive &= ~covers(chosen)
    return rules


def learn(
    stats: DataFrame,
    labels: DataFrame,
    *,
    precision: float = 0.9,
    least: int = 5,
    max_rules: int = 12,
    max_conditions: int = 4,
) -> list[Rule]:
    """Rules from all rows of `stats` that have a label (doc_id, quality: 0 is bad, 1 good).

    Two thirds of the documents grow the rules, a third prunes them, by a hash of doc_id. Without
    labels of both kinds there are no rules.
    """
    scratch = Scratch(stats.sparkSession, "quality-labels")
    names = list(measures())
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad")
    )
    rows = scratch.write(
        stats.filter(~base_failed())
        .join(known, "doc_id")
        .select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("other"),
                *[c.alias(n) for n, c in measures().items()]),
        "rows",
    )
    quantiles = rows.agg(*[F.percentile_approx(n, QUANTILES, 10_000).alias(n) for n in names]).first()
    # Half-way between neighbouring quantiles, so that no threshold lies on a common value.
    values = [sorted(set(quantiles[n] or [])) for n in names]
    edges = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in values]
    bin_of = lambda n, e: sum(((F.col(n) > x).cast("int") for x in e), F.lit(0))
    count = lambda c: F.sum(c.cast("long"))
    bad, other = F.col("bad"), F.col("other")
    cells = (
        rows.groupBy(*[bin_of(n, e).alias(n) for n, e in zip(names, edges, strict=True)])
        .agg(count(bad & ~other), count(~bad & ~other), count(bad & other), count(~bad & other))
        .collect()
    )
    scratch.drop("rows")
    if not cells:
        return []
    table = np.array([list(c) for c in cells], np.int64)
    return _covering(
        table[:, : len(names)], table[:, len(names) :], edges, names,
        precision, least, max_rules, max_conditions,
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each row of `docs` (doc_id, text) with base_failed and kept.

    A null or empty text has no words and fails the base rules. Repeated rows are judged one by one; a
    row without doc_id is judged too but has no label. Labels of either kind may be missing. Other
    columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(statistics(docs), "statistics")
    rules = learn(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )
