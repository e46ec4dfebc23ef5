"""Analysis of review rows and of review batches."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.operators.clean import validate
from starcheck.operators.duplicates import EPS, MIN_SAMPLES, cluster_summary, text_clusters
from starcheck.operators.explain import explain_flagged
from starcheck.operators.mismatch import (
    DEFAULT_THRESHOLD,
    Transform,
    lexicon_classifier,
    score_mismatch,
)
from starcheck.operators.train import choose_classifier, explain_with_model
from starcheck.session import cut

ANALYSIS_COLUMNS = [
    "review_id", "rating", "predicted_sentiment", "sentiment_confidence", "mismatch_score",
    "is_flagged", "reason", "explanation", "explanation_method",
]


def analyze_rows(
    df: DataFrame,
    classifier: Transform = lexicon_classifier,
    threshold: float = DEFAULT_THRESHOLD,
    keep: tuple[str, ...] = (),
    explainer: Transform = explain_flagged,
    classifier_name: str | None = None,
) -> DataFrame:
    """Score every row and explain the flagged ones, the same for batch and stream.

    With the word lists all is narrow. A model brings its own explainer (see model_analysis()); with a
    classifier_name the rows say what judged them.
    """
    rows = score_mismatch(df, classifier, threshold).transform(explainer)
    named = [] if classifier_name is None else [F.lit(classifier_name).alias("classifier")]
    return rows.select(*keep, *ANALYSIS_COLUMNS, *named)


def model_analysis(
    df: DataFrame,
    path: str | None,
    terms: DataFrame | None,
    key: str,
    threshold: float = DEFAULT_THRESHOLD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """analyze_rows() with the model at `path` and its term table, or with the word lists if there is none.

    The column `classifier` says which of the two judged the rows.
    """
    classifier, name = choose_classifier("model", path, lexicon_classifier)
    explainer = explain_flagged
    if name == "model" and terms is not None:
        explainer = partial(explain_with_model, terms=terms, key=key)
    return analyze_rows(df, classifier, threshold, keep, explainer, name)


def analyze_batch(
    rows: DataFrame,
    classifier: Transform = lexicon_classifier,
    threshold: float = DEFAULT_THRESHOLD,
    explainer: Transform = explain_flagged,
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """(results, clusters) of request batches: rows with batch_id, review_index, review_id, rating and text.

    Results have all analysis columns and cluster_id, null outside of clusters; clusters have their size
    and a representative text. Invalid rows are left out: see clean.rejects(), and reject_batches() for
    bodies without rows.
    """
    item = ["batch_id", "review_index"]
    valid = cut(rows.transform(validate))
    members = cut(text_clusters(valid.select(*item, "text"), eps, min_samples))
    results = analyze_rows(valid, classifier, threshold, tuple(item), explainer)
    results = results.join(members.select(*item, "cluster_id"), item, "left")
    return results, cluster_summary(members, valid)


def exploded_explanations(analysis: DataFrame, key: str = "review_id") -> DataFrame:
    """One row per contribution, numbered in order."""
    return analysis.select(
        key, F.posexplode("explanation").alias("position", "_part")
    ).select(key, "position", "_part.token", "_part.weight")
