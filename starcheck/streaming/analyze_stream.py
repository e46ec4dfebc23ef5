"""Online scoring: the batch transforms run on a stream of requests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starcheck.operators.clean import rejects, validate
from starcheck.operators.duplicates import EPS, MIN_SAMPLES, cluster_summary, text_clusters
from starcheck.operators.mismatch import DEFAULT_THRESHOLD
from starcheck.operators.positions import with_position
from starcheck.plans.analyze import analyze_rows
from starcheck.schema import REQUEST


def read_request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Single-review requests from JSON lines that arrive as files in a folder."""
    return spark.readStream.schema(REQUEST).json(path)


def analyze_stream(requests: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Valid requests, scored and explained. Stateless, so any trigger gives the same rows.

    The others are in reject_stream(); both together are all requests.
    """
    return requests.transform(validate).transform(analyze_rows, threshold=threshold)


def reject_stream(requests: DataFrame) -> DataFrame:
    """Requests that cannot be scored, each with its reject_reason, for a sink of their own."""
    return requests.transform(rejects)


def write_stream(analysis: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet; the checkpoint makes each row arrive exactly once."""
    return (
        analysis.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_duplicates(
    requests: DataFrame, path: str, checkpoint: str, key: str, eps: float = EPS, min_samples: int = MIN_SAMPLES
) -> StreamingQuery:
    """Near-duplicate clusters of each micro-batch, which counts as one request batch.

    `key` is a unique BIGINT in the requests. A micro-batch that is run again after a failure
    replaces its own output.
    """

    def cluster(batch: DataFrame, batch_no: int) -> None:
        rows = batch.transform(validate).withColumn("batch_id", F.lit(batch_no).cast("long"))
        docs = with_position(rows, ["batch_id"], key, "review_index").select("batch_id", "review_index", "text")
        summary = cluster_summary(text_clusters(docs, eps, min_samples), docs)
        summary.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_no}")

    return (
        requests.writeStream.foreachBatch(cluster)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
