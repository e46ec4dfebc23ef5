"""Request bodies of a stream into three sinks from one parse: analysis rows, row rejects, body rejects.

Each micro-batch is parsed once and kept in memory while its three outputs are written. Every output
goes to a folder named by the micro-batch id and replaces it, so a micro-batch that is run again after
a failure leaves the same files, not a second copy. A body that is no JSON of the right form keeps its
whole text in the body-reject sink, beside its reason (malformed_body, empty_batch), so no request is
lost: analysis rows plus row rejects are all reviews of the well-formed bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starcheck.operators.clean import rejects, validate
from starcheck.plans.analyze import analyze_rows
from starcheck.sources.requests import parsed_bodies

SINKS = ("analysis", "row_rejects", "body_rejects")


def split_batch(batch: DataFrame, body: str = "body") -> dict[str, DataFrame]:
    """The three outputs of one parse of `batch`."""
    parsed = parsed_bodies(batch, body)
    others = [c for c in batch.columns if c != body]
    bad = parsed.filter(F.col("reject_reason").isNotNull()).select(*others, body, "reject_reason")
    rows = parsed.filter(F.col("reject_reason").isNull()).select(
        *others, F.posexplode("_reviews").alias("review_index", "_review")
    ).select(*others, "review_index", "_review.*")
    return {
        "analysis": analyze_rows(rows.transform(validate), keep=(*others, "review_index")),
        "row_rejects": rejects(rows).select(*others, "review_index", "review_id", "reject_reason"),
        "body_rejects": bad,
    }


def write_request_sinks(requests: DataFrame, path: str, checkpoint: str, body: str = "body") -> StreamingQuery:
    """Run the stream until its input is read; each sink is a folder under `path`."""

    def handle(batch: DataFrame, batch_no: int) -> None:
        batch = batch.persist()
        try:
            for name, out in split_batch(batch, body).items():
                out.write.mode("overwrite").parquet(f"{path}/{name}/micro_batch={batch_no}")
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sinks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in SINKS}
