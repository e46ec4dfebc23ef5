"""Packing tokenised documents into sequences by Karmarkar-Karp multiway differencing.

A document's tokens, with an end token, are cut into full sequences and pieces of at most `piece`
tokens of what is left; this depends on the document alone, so texts are never shuffled. A full sequence
is done as it is and is not shuffled. The pieces of what is left fall into groups of a bounded number of
tokens by a hash. In a group, differencing keeps partial
partitions of all windows and merges the two with the largest spread, the fullest window of one with
the emptiest of the other, until one is left. If its fullest window is over the capacity, the group is
dealt again with one window more.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch
from starcheck.llm.words import slices

CAPACITY = 2048
PIECE = 512
#: Windows of a group. More windows waste less and cost more time; the group's size in memory is bounded.
WINDOWS = 128
END = 1
#: Full sequences are numbered from here on, by their place in the written pieces; group numbers end far below.
FULL = 1 << 62


class Window(NamedTuple):
    total: int
    items: tuple[int, ...]


def difference(sizes: list[int], windows: int) -> list[Window]:
    """Deal the items to so many windows of near-equal totals; empty windows are left out.

    A partial partition is a list of its windows, fullest first; windows that are still empty are not
    in the list.
    """
    heap: list[tuple[int, int, list[Window]]] = []
    for k, size in enumerate(sizes):
        heap.append((-size if windows > 1 else 0, k, [Window(size, (k,))]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = len(one) + len(two) - windows
        if meet > 0:
            # The emptiest windows of one meet the emptiest of the other, in opposite order.
            kept_one, kept_two = one[: len(one) - meet], two[: len(two) - meet]
            met = [
                Window(a.total + b.total, a.items + b.items)
                for a, b in zip(one[len(one) - meet :], reversed(two[len(two) - meet :]), strict=True)
            ]
        else:
            kept_one, kept_two, met = one, two, []
        merged = sorted([*kept_one, *kept_two, *met], key=lambda w: -w.total)
        spread = merged[0].total - (merged[-1].total if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    return heap[0][2] if heap else []


def deal(sizes: list[int], capacity: int) -> list[Window]:
    """Windows of at most `capacity`: as few as the total allows, then more while one is too full."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if not found or found[0].total <= capacity:
            return found
        windows += 1


class Tokens:
    """Token ids of a tokenizer file, by a faster library with the same vocabulary where there is one.

    `ranks` names a file of that vocabulary by rank and `pattern` how words are split. Very long runs of
    white space, which the faster library can't split, are left to the file's own tokenizer.
    """

    LONG = 50_000

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self.path, self.slow, self.fast = path, None, None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None and not (
            len(text) >= self.LONG and re.search(rf"\s{{{self.LONG}}}", text)
        ):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            # Spark already runs a task per core.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Vocabulary(NamedTuple):
    """Where a tokenizer lies; each executor has the files."""

    path: str
    ranks: str | None = None
    pattern: str | None = None


def _cut(vocabulary: Vocabulary, capacity: int, piece: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = Tokens(*vocabulary), 0
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "crc", "tokens", "row", "ids")}
            for doc, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                ids = np.append(tokens.of(text or ""), np.uint32(end)).astype("<u4")
                whole = len(ids) // capacity * capacity
                starts = [*range(0, whole, capacity), *range(whole, len(ids), piece)]
                for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                    part = ids[a:b]
                    out["doc"].append(doc)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["crc"].append(zlib.crc32(part.tobytes()))
                    out["tokens"].append(len(ids))
                    out["row"].append(row)
                    out["ids"].append(part.astype(np.int32) if with_ids else None)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(out[k], pa.int64()) for k in ("doc", "start", "length", "crc", "tokens", "row")),
                    pa.array(out["ids"], pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids"],
            )

    return run


def _deal_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        order = table.select(["doc_id", "row", "start", "length", "ids_crc32"]).to_pandas()
        order = order.sort_values(["doc_id", "row", "start", "length", "ids_crc32"], kind="stable")
        table = table.take(pa.array(order.index.to_numpy()))
        lengths = table.column("length").to_pylist()
        dealt = [w.items for w in deal(lengths, capacity)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(dealt):
            at = 0
            for k in sorted(items):
                sequence[k], offset[k] = (group << 32) + number, at
                at += lengths[k]
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        return (
            table.select(columns)
            .append_column("sequence_id", pa.array(sequence))
            .append_column("offset", pa.array(offset))
        )

    return run


def pack(
    docs: DataFrame,
    vocabulary: Vocabulary,
    *,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    windows: int = WINDOWS,
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of each row of `docs` (doc_id, text), with its sequence and offset there.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset. The files of
    `vocabulary` are on each executor. Strings of special tokens in a text are ordinary text. A null text counts as empty and has the end token alone. Repeated rows and rows without
    doc_id are packed like all others. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, ids array<int>"
    pieces = scratch.write(
        rows.mapInArrow(_cut(vocabulary, capacity, piece, end, with_ids), columns), "pieces"
    )
    tails = pieces.filter(F.col("length") < capacity)
    tokens = tails.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (capacity * windows)))
    group = F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)).alias("group")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    dealt = (
        tails.select("*", group)
        .groupBy("group")
        .applyInArrow(_deal_group(capacity), f"{schema}, sequence_id long, offset long")
    )
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids",
        (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    result = scratch.write(full.unionByName(dealt), "result")
    scratch.drop("pieces")
    return result
