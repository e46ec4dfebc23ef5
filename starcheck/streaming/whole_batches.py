"""Request batches on a stream, held until they are whole, then clustered as in batch mode.

Rows of one request batch may arrive in several files and so in several micro-batches. Every row says
how many rows its batch has (batch_size). Keyed state per batch_id counts the rows that have come;
it holds two numbers, never the rows, so a batch of any size costs the same state. When the count
reaches batch_size the batch is whole and is emitted once. An event-time timer closes a batch that is
still incomplete when the watermark (on the time the rows were sent) has passed its last row by HOLD,
and emits it as incomplete, so no batch waits forever. An event-time timer, unlike a processing-time
one, asks for no empty micro-batches, so a stream read with availableNow ends.

For each micro-batch of emitted batches, `foreachBatch` reads their rows from the input (a join on
batch_id, planned by Spark like any other) and clusters them with the batch code. Its output goes to a
folder named by the micro-batch id and replaces it: a micro-batch run again leaves the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from starcheck.operators.duplicates import EPS, MIN_SAMPLES, cluster_summary, text_clusters
from starcheck.session import cut

#: An incomplete batch is closed this long after its last row was sent.
HOLD = "10 minutes"
HOLD_MS = 10 * 60 * 1000
EVENTS = "batch_id long, received long, expected long, whole boolean"
COUNTS = "received long, expected long"


def _count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add up the rows of one batch; emit it once when whole, or when its timer fires."""
    (batch_id,) = key
    if state.hasTimedOut:
        received, expected = state.get
        state.remove()
        yield pd.DataFrame({"batch_id": [batch_id], "received": [received], "expected": [expected], "whole": [False]})
        return
    received, expected = state.get if state.exists else (0, 0)
    last = None
    for part in parts:
        received += len(part)
        expected = max(expected, int(part["batch_size"].max()))
        sent = pd.to_datetime(part["sent"]).max()
        last = sent if last is None or sent > last else last
    if received >= expected:
        state.remove()
        yield pd.DataFrame({"batch_id": [batch_id], "received": [received], "expected": [expected], "whole": [True]})
    else:
        state.update((received, expected))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + HOLD_MS, state.getCurrentWatermarkMs() + 1))


def completed_batches(rows: DataFrame) -> DataFrame:
    """(batch_id, received, expected, whole): one event per batch, when it is whole or closed."""
    keyed = rows.select(F.col("batch_id").cast("long"), F.col("batch_size").cast("long"), "sent")
    keyed = keyed.filter("batch_id is not null").withWatermark("sent", HOLD)
    return keyed.groupBy("batch_id").applyInPandasWithState(
        _count, EVENTS, COUNTS, "append", GroupStateTimeout.EventTimeTimeout
    )


def write_whole_batches(
    spark: SparkSession,
    source: DataFrame,
    input_path: str,
    path: str,
    checkpoint: str,
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
) -> StreamingQuery:
    """Cluster each batch of the stream `source` (read from `input_path`) once it is whole.

    Rows have batch_id, review_index, batch_size, sent (a timestamp) and text; all rows are clustered, as text_clusters()
    does in batch mode. The summaries of a micro-batch's batches go
    to `path`/micro_batch=N, with whole saying if the batch was complete.
    """
    schema = source.schema

    def cluster(events: DataFrame, batch_no: int) -> None:
        # The events are computed once: every job below reads them from the shared folder.
        events.select("batch_id", "whole").write.mode("overwrite").parquet(f"{path}/_events/micro_batch={batch_no}")
        done = spark.read.parquet(f"{path}/_events/micro_batch={batch_no}")
        if done.isEmpty():
            return
        rows = spark.read.schema(schema).parquet(input_path).join(done, "batch_id")
        # Clustering reads the rows several times; they are looked up once.
        docs = cut(rows.select("batch_id", "review_index", "text"))
        summary = cluster_summary(text_clusters(docs, eps, min_samples), docs)
        summary.join(done, "batch_id").write.mode("overwrite").parquet(f"{path}/micro_batch={batch_no}")

    return (
        completed_batches(source).writeStream.foreachBatch(cluster)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
