"""Batches that span two files of a stream are clustered once, when whole; incomplete ones wait."""

import os
import tempfile

from pyspark.sql import functions as F

from starcheck.streaming import whole_batches

SCHEMA = "batch_id long, review_index long, rating int, text string, batch_size long"


def test_whole_batches_across_files(spark):
    same = "the same long text about a lamp that broke on the first day"
    rows = [(1, i, 3, same if i < 3 else f"other words number {i} here", 5) for i in range(5)]
    rows += [(2, i, 3, same, 2) for i in range(2)]
    rows += [(3, 0, 3, same, 4), (3, 1, 3, same, 4)]  # two rows of four: never whole here
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sent", F.current_timestamp())
    base = tempfile.mkdtemp()
    source = os.path.join(base, "in")
    df.filter("review_index % 2 = 0").write.parquet(source)
    first = len(spark.read.parquet(source).inputFiles())
    df.filter("review_index % 2 = 1").write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", first).parquet(source)
    out = os.path.join(base, "out")
    whole_batches.write_whole_batches(spark, stream, source, out, os.path.join(base, "state"), 0.15, 2).awaitTermination()
    got = spark.read.parquet(f"{out}/micro_batch=*").collect()
    assert sorted((r.batch_id, r.size, r.first_index, r.whole) for r in got) == [(1, 2, 3, True), (1, 3, 0, True), (2, 2, 0, True)]
    events = spark.read.parquet(f"{out}/_events/micro_batch=*").collect()
    assert sorted(r.batch_id for r in events) == [1, 2]
