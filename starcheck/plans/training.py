"""Train candidate models, compare them and keep the runs."""

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.operators.clean import load_and_clean
from starcheck.operators.evaluate import metrics, stratified_split
from starcheck.operators.features import MAX_TERMS, MIN_TEXTS, fit_features
from starcheck.operators.train import predict, train_classifier
from starcheck.session import cut
from starcheck.sources.runs import comparison_table, log_run, read_runs

# Settings of train_classifier() by run name.
CANDIDATES = {
    "tfidf-logreg-baseline": {},
    "tfidf-logreg-small": {"max_terms": 100},
    "tfidf-logreg-tight": {"inverse_regularisation": 0.01},
}


def split_frames(reviews: DataFrame, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """Cleaned training and test rows (key, text, label).

    The cleaned rows are written once, as the split reads them more than once, and so is the
    split, as training does.
    """
    cleaned = cut(reviews.transform(load_and_clean).select(key, "text", "label"))
    rows = cut(stratified_split(cleaned, key))
    return rows.filter("is_train").drop("is_train"), rows.filter(~F.col("is_train")).drop("is_train")


def milliseconds_per_row(df: DataFrame, model: PipelineModel) -> float:
    """Wall time of scoring all rows as one job, per row."""
    rows = df.count()
    start = time.perf_counter()
    predict(df, model).write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - start) * 1000 / max(rows, 1)


def train_and_compare(
    reviews: DataFrame, runs_path: str, experiment: str, candidates: dict[str, dict] = CANDIDATES
) -> DataFrame:
    """Split the reviews, fit every candidate, and return the comparison table."""
    return compare(*split_frames(reviews), runs_path, experiment, candidates)


def compare(
    train: DataFrame, test: DataFrame, runs_path: str, experiment: str, candidates: dict[str, dict] = CANDIDATES
) -> DataFrame:
    """Fit every candidate on the same rows, log each run, and return the comparison table."""
    spark = train.sparkSession
    features = {}
    for name, settings in candidates.items():
        # Candidates with the same terms share their features.
        wanted = settings.get("max_terms", MAX_TERMS), settings.get("min_texts", MIN_TEXTS)
        if wanted not in features:
            features[wanted] = fit_features(train, *wanted)
        model = train_classifier(train, **settings, features=features[wanted])
        found = metrics(predict(test, model)).first()
        log_run(
            spark,
            runs_path,
            experiment=experiment,
            run=name,
            model_type="tfidf_logreg",
            accuracy=found["accuracy"],
            f1_macro=found["f1_macro"],
            latency_ms=milliseconds_per_row(test, model),
        )
    return comparison_table(read_runs(spark, runs_path, experiment))
