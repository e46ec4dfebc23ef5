"""TF-IDF of texts that stay where they are: only the distinct terms of many texts at a time are shuffled.

The words of some texts are counted in a task and written as one piece. The frequencies of its distinct terms in
their batch come back to the piece, and its texts are weighed there.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcheck.operators.skew import lookup_join
from starcheck.operators.term_counts import flat_words, per_text, pieces, words_of
from starcheck.session import Scratch

BATCH, INDEX = "batch_id", "review_index"
# Words of a piece, and rows given out at a time.
WORDS = 2_000_000
ROWS_OUT = 50_000
# Sizes of so many batches are broadcast.
FEW_BATCHES = 100_000


def _pack(words: int, index: pa.DataType):
    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(rows, words):
            row, flat = flat_words(piece)
            if not len(flat):
                continue
            known = flat.dictionary_encode()
            size = len(known.dictionary)
            batches, batch_no = np.unique(piece[BATCH].to_numpy(), return_inverse=True)
            text, code, tf = per_text(row, known.indices.to_numpy().astype(np.int64), size)
            # A term has a place of its own for each batch.
            place = batch_no[text] * size + code
            places = np.arange(size)
            if len(batches) > 1:
                places = np.unique(place)
                place = np.searchsorted(places, place)
            entries = pa.table({"text": pa.array(text, pa.int32()), "place": pa.array(place, pa.int32()), "tf": pa.array(tf, pa.int32())})
            yield pa.RecordBatch.from_pydict(
                {
                    "batches": _one_list(pa.array(batches[places // size], pa.int64())),
                    "terms": _one_list(known.dictionary.take(pa.array(places % size))),
                    "counts": _one_list(pa.array(np.bincount(place, minlength=len(places)), pa.int32())),
                    "entries": pa.array([_bytes(entries)], pa.binary()),
                    "texts": pa.array([_bytes(pa.table({INDEX: piece[INDEX].cast(index)}))], pa.binary()),
                }
            )

    return pack


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in rows:
        for k in range(some.num_rows):
            entries, texts = (pa.ipc.open_stream(some[name][k].as_buffer()).read_all() for name in ("entries", "texts"))
            batch, terms, idf = (some[name][k].values for name in ("batches", "terms", "idf"))
            text, place, tf = (entries[name].to_numpy() for name in ("text", "place", "tf"))
            raw = tf * idf.to_numpy()[place]
            weight = raw / np.sqrt(np.bincount(text, raw * raw))[text]
            for at in range(0, len(raw), ROWS_OUT):
                part = slice(at, at + ROWS_OUT)
                of_part = pa.array(place[part])
                index = texts[INDEX].combine_chunks().take(pa.array(text[part]))
                yield from pa.table(
                    {BATCH: batch.take(of_part), INDEX: index, "term": terms.take(of_part), "weight": weight[part]}
                ).to_batches()


def weigh_in_pieces(docs: DataFrame, sizes: DataFrame, words: int = WORDS) -> DataFrame:
    """(batch_id, review_index, term, weight): unit-length TF-IDF vectors of texts that are one row each.

    `sizes` comes from batch_sizes(). A term has one row per piece and batch in the shuffles, and a piece is one
    row of bounded size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "term-pieces")
    index = docs.schema[INDEX]
    texts = words_of(docs.filter(F.col(BATCH).isNotNull()), F.col(BATCH).cast("long").alias(BATCH), INDEX)
    arrow = pa.string() if isinstance(index.dataType, T.StringType) else pa.int64()
    packed = scratch.write(
        texts.mapInArrow(
            _pack(words, arrow),
            "batches array<long>, terms array<string>, counts array<int>, entries binary, texts binary",
        ).withColumn("piece", F.monotonically_increasing_id()),
        "pieces",
    )
    zipped = F.arrays_zip("batches", "terms", "counts")
    held = packed.select("piece", F.posexplode(zipped).alias("place", "_at")).select(
        "piece", "place", F.col("_at.batches").alias(BATCH), F.col("_at.terms").alias("term"), F.col("_at.counts").alias("n")
    )
    # A window sees one row per piece.
    df = F.sum("n").over(Window.partitionBy(BATCH, "term"))
    held = held.withColumn("df", df)
    if sizes.count() <= FEW_BATCHES:
        weighed = held.join(F.broadcast(sizes), BATCH)
    else:
        weighed = lookup_join(held, sizes, [BATCH], "term", matches="batch_size")
    idf = F.ln((1.0 + F.col("batch_size")) / (1.0 + F.col("df"))) + 1.0
    of_piece = weighed.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("place", idf.alias("idf")))).alias("_idf"))
    ready = packed.join(of_piece, "piece").select("batches", "terms", F.col("_idf.idf").alias("idf"), "entries", "texts")
    schema = T.StructType(
        [
            T.StructField(BATCH, T.LongType()),
            T.StructField(INDEX, T.StringType() if arrow == pa.string() else T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )
    return ready.mapInArrow(_weigh, schema).select(
        F.col(BATCH).cast(docs.schema[BATCH].dataType), F.col(INDEX).cast(index.dataType), "term", "weight"
    )
