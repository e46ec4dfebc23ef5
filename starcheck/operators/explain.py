"""Which words pushed a flagged review."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.lexicon import lexicon_hits, signed_hits

TOP_TOKENS = 8
CONTRIBUTIONS = "array<struct<token:string,weight:double>>"


def lexicon_explanation(
    text: Column, label: Column, limit: int = TOP_TOKENS, hits: Column | None = None
) -> Column:
    """The first hits of a text with signed weights, in text order."""
    return signed_hits(lexicon_hits(text) if hits is None else hits, label, limit).cast(
        CONTRIBUTIONS
    )


def explain_flagged(scored: DataFrame, limit: int = TOP_TOKENS) -> DataFrame:
    """Add explanation and explanation_method; both null unless the row is flagged."""
    hits = F.col("hits") if "hits" in scored.columns else None
    explanation = lexicon_explanation(F.col("text"), F.col("predicted_sentiment"), limit, hits)
    return scored.withColumns(
        {
            "explanation": F.when(F.col("is_flagged"), explanation),
            "explanation_method": F.when(F.col("is_flagged"), "lexicon_fallback"),
        }
    )
