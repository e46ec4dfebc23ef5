"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of source, language and topic. Raking finds a factor for each value of
each dimension so that the weighted cells have the target totals of all dimensions at once. Documents
are then sampled, each by itself, with a probability proportional to the weight of its cell.

The cells are read in each round and never rewritten; what changes are three small tables of factors.
No table passes through the driver, however many sources there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch
from starcheck.llm.words import WORD

#: A target: shares by value (values that are not named keep their share of all tokens, the named
#: ones divide the rest), or an exponent for the observed shares (1 leaves them, 0 levels them).
Target = Mapping[str, float] | float
MAX_ROUNDS = 12
TOLERANCE = 1e-3
NULL = "null"


def form_topic(text: Column) -> Column:
    """A topic by the form of the text, for corpora without topic labels."""
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return (
        F.when(words < 50, "short")
        .when(symbols * 10 > words, "symbols")
        .when(words > 2000, "long")
        .otherwise("prose")
    )


def _key(column: Column) -> Column:
    """Values as text; a null is a value of its own and not the text of the same name."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(NULL))


def _targets(cells: DataFrame, dim: str, target: Target) -> DataFrame:
    """(dim, goal, factor): the tokens each value shall have; the factors start at 1."""
    seen = cells.groupBy(dim).agg(F.sum("tokens").alias("seen"))
    if isinstance(target, Mapping):
        named = F.create_map(*[F.lit(x) for k, v in target.items() for x in (f"={k}", float(v))])
        raw = F.coalesce(F.try_element_at(named, F.col(dim)), F.lit(0.0)) if target else F.lit(0.0)
        is_named = F.try_element_at(named, F.col(dim)).isNotNull() if target else F.lit(False)
        seen = seen.select(dim, "seen", raw.alias("raw"), is_named.alias("named"))
        sums = seen.agg(
            F.sum("seen").alias("all_seen"),
            F.sum(F.when(F.col("named"), F.col("seen")).otherwise(0)).alias("named_seen"),
            F.sum("raw").alias("all_raw"),
        )
        goal = F.when(F.col("named"), F.col("raw") / F.col("all_raw") * F.col("named_seen"))
        goal = goal.otherwise(F.col("seen"))
    else:
        seen = seen.withColumn("raw", F.pow("seen", F.lit(float(target))))
        sums = seen.agg(F.sum("seen").alias("all_seen"), F.sum("raw").alias("all_raw"))
        goal = F.col("raw") / F.col("all_raw") * F.col("all_seen")
    # One row of sums.
    both = seen.join(F.broadcast(sums), F.lit(True))
    return both.select(dim, goal.cast("double").alias("goal"), F.lit(1.0).alias("factor"))


def rake(
    cells: DataFrame,
    targets: Mapping[str, Target],
    scratch: Scratch,
    *,
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """`cells` (the dimensions, tokens) with `weight`: tokens * weight has the target totals.

    Stops when all totals are within `tolerance` of their targets, or after `max_rounds`: targets that
    contradict each other, or call for tokens that no cell has, are only approached.
    """
    dims = list(targets)
    factors = {d: scratch.write(_targets(cells, d, targets[d]), f"factor-{d}-0") for d in dims}
    names: list[str] = [f"factor-{d}-0" for d in dims]
    for number in range(1, max_rounds + 1):
        worst = 0.0
        for dim in dims:
            rows, weight = cells, F.col("tokens")
            for other in (d for d in dims if d != dim):
                found = factors[other].select(other, F.col("factor").alias(f"_{other}"))
                rows, weight = rows.join(found, other), weight * F.col(f"_{other}")
            sums = rows.groupBy(dim).agg(F.sum(weight).alias("sum"))
            new = factors[dim].join(sums, dim).select(
                dim,
                "goal",
                F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(F.col("factor")).alias("factor"),
                F.when(F.col("goal") > 0, F.abs(F.col("factor") * F.col("sum") / F.col("goal") - 1))
                .otherwise(0.0)
                .alias("off"),
            )
            names.append(f"factor-{dim}-{number}")
            factors[dim] = scratch.write(new, names[-1])
            worst = max(worst, factors[dim].agg(F.max("off")).first()[0] or 0.0)
        if worst <= tolerance:
            break
    rows, weight = cells, F.lit(1.0)
    for dim in dims:
        rows = rows.join(factors[dim].select(dim, F.col("factor").alias(f"_{dim}")), dim)
        weight = weight * F.col(f"_{dim}")
    result = scratch.write(rows.select(*dims, "tokens", weight.alias("weight")), "raked")
    scratch.drop(*names)
    return result


def _scale(raked: DataFrame, budget: float, passes: int = 4, steps: int = 32) -> float:
    """The s with sum(tokens * min(1, s * weight)) = budget * all tokens, by nested grids."""
    total, highest = raked.filter("weight > 0").agg(
        F.sum("tokens"), F.max(1 / F.col("weight"))
    ).first()
    if not total:
        return 0.0
    all_tokens = raked.agg(F.sum("tokens")).first()[0]
    low, high = 0.0, highest
    for _ in range(passes):
        grid = [low + (high - low) * k / steps for k in range(steps + 1)]
        tokens = raked.agg(
            *[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s)) for s in grid]
        ).first()
        at = next((k for k in range(1, steps + 1) if tokens[k] >= budget * all_tokens), steps)
        low, high = grid[at - 1], grid[at]
    return high


def mix(
    docs: DataFrame,
    *,
    source: Target = 0.5,
    lang: Target = 0.5,
    topic: Target = 1.0,
    topic_of: Column | None = None,
    budget: float = 0.5,
    seed: int = 17,
) -> DataFrame:
    """Each row of `docs` as the struct `row`, with topic, tokens, weight, probability and kept.

    `budget` is the expected share of all tokens (words) that is sampled, as far as the targets leave
    that many: no document is taken twice, so a probability ends at 1. A row's fate hangs on its
    doc_id and text, so repeated rows share it. A null source, language or topic is a value of its own.
    A null or empty text has no tokens and is sampled like its cell; a cell without any tokens keeps
    the weight its values have. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = docs["text"].cast("string")
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        (form_topic(text) if topic_of is None else topic_of).alias("topic"),
    ).withColumns(
        {"k_source": _key(F.col("row.source")), "k_lang": _key(F.col("row.lang")), "k_topic": _key(F.col("topic"))}
    )
    dims: Sequence[str] = ("k_source", "k_lang", "k_topic")
    cells = scratch.write(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, dict(zip(dims, (source, lang, topic), strict=True)), scratch)
    scale = _scale(raked, budget)
    scratch.drop("cells")
    chance = F.least(F.lit(1.0), F.col("weight") * scale).alias("probability")
    spot = F.pmod(F.xxhash64(F.lit(seed), "row.doc_id", "row.text"), F.lit(1 << 53)) / float(1 << 53)
    return (
        rows.join(raked.select(*dims, "weight", chance), list(dims))
        .withColumn("kept", spot < F.col("probability"))
        .drop(*dims)
    )


#: The mix of the registered query and of the pipeline.
PRODUCTION = {
    "source": 0.5,
    "lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2},
    "topic": {"prose": 0.7, "long": 0.2, "short": 0.05, "symbols": 0.05},
    "budget": 0.5,
}
