"""The log of experiment runs, one row per run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.schema import RUNS

# Columns of the comparison table and where they come from.
COMPARISON_COLUMNS = {
    "run": "run",
    "model_type": "model_type",
    "accuracy": "accuracy",
    "f1_macro": "f1_macro",
    "latency_ms": "latency_ms",
}


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the log; metrics a run does not have are null."""
    missing = [f for f in RUNS.fields if f.name not in runs.columns]
    complete = runs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    complete.select(*[F.col(f.name).cast(f.dataType) for f in RUNS.fields]).write.mode(
        "append"
    ).parquet(path)


def log_run(spark: SparkSession, path: str, **fields) -> None:
    """Add one run."""
    row = tuple(fields.get(name) for name in RUNS.fieldNames())
    append_runs(spark.createDataFrame([row], RUNS), path)


def read_runs(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    runs = spark.read.schema(RUNS).parquet(path).filter(F.col("experiment") == experiment)
    if runs.isEmpty():
        raise ValueError(f"no experiment named {experiment} found at {path}")
    return runs


def comparison_table(runs: DataFrame) -> DataFrame:
    """The columns there are, best macro F1 first."""
    present = [F.col(c).alias(name) for name, c in COMPARISON_COLUMNS.items() if c in runs.columns]
    return runs.select(*present).orderBy(F.desc_nulls_last("f1_macro"))
