"""Removal of passages that repeat across documents, by level-wise doubling.

A word is removed when a window of `window` consecutive words around it also starts in a document
with a smaller doc_id. Windows are found level by level: the lengths double up to `window`, each half
of the next rounded up (13, 25, 50). A window of the target length stands or falls with the shorter
window inside it that has the least hash: equal windows choose equal ones. At each level only the
chosen windows that occur in two documents survive, and only what surrounds a survivor is looked at
at the next level, until the target is reached or no candidates survive. So the first level, the only
one over all text, hands on about two hashes for each `window - length + 2` words.

Documents with the same words as a smaller one are found in the first pass and go no further. The
last level tells windows apart by 128 bits; a false match at a shorter level is only extended in vain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch
from starcheck.llm.words import Codes, mix, slices, sliding_min, texts, window_hash

WINDOW = 50
SHORTEST = 13
_SECOND = 0xD1342543DE82EF95
ROWS = "doc_id long, digest long, h1 long, h2 long, start int"
STAGED = "doc_id long, digest long, n_words long, n_removed long, kept string, runs array<int>"


def levels(window: int, shortest: int) -> list[int]:
    """Lengths that double up to the window, the first of at most `shortest` words."""
    found = [window]
    while found[0] > max(shortest, 1):
        found.insert(0, (found[0] + 1) // 2)
    return found


def chosen(codes: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each start of a window, the least hash of a window of `length` words inside it."""
    return sliding_min(window_hash(codes, length), window - length + 1)


def _digest(words: list[bytes]) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
    return int(both[0]), int(both[1])


def runs_of(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the true stretches, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))


def starts_of(runs: list[int]) -> np.ndarray:
    parts = [np.arange(a, b) for a, b in zip(runs[::2], runs[1::2], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words a window from one of the starts covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _rows(columns: dict[str, list[np.ndarray]], counts: list[int], keys: dict[str, list[int]]) -> pa.RecordBatch:
    arrays = {k: pa.array(np.repeat(np.array(v, np.int64), counts)) for k, v in keys.items()}
    empty = np.zeros(0, np.int64)
    arrays["h1"] = pa.array(np.concatenate([empty, *columns["h1"]]))
    arrays["h2"] = pa.array(np.concatenate([empty, *columns["h2"]]))
    arrays["start"] = pa.array(np.concatenate([empty, *columns["start"]]).astype(np.int32))
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _hashes(window: int, length: int, first: bool):
    """The chosen windows of a level. Of whole documents at first, later of candidate runs.

    At first a document also gives its own digest, with start -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        text = "text" if first else "kept"
        for batch in slices(batches, text):
            columns: dict[str, list[np.ndarray]] = {"h1": [], "h2": [], "start": []}
            counts, ids, digests = [], [], []
            all_runs = None if first else batch.column("runs").to_pylist()
            known = None if first else batch.column("digest").to_pylist()
            for k, (doc, raw) in enumerate(
                zip(batch.column("doc_id").to_pylist(), texts(batch.column(text)), strict=True)
            ):
                words = (raw or b"").split()
                if doc is None or len(words) < window:
                    continue
                own = codes.of(words)
                d1, d2 = _digest(words) if first else (known[k], 0)
                starts = None if first else starts_of(all_runs[k])
                if length < window:
                    h1 = chosen(own, window, length)
                    h1 = h1 if starts is None else h1[starts]
                    h1 = h1[np.concatenate([[True], h1[1:] != h1[:-1]])].view(np.int64)
                    h2 = start = np.zeros(len(h1), np.int64)
                else:
                    h1 = window_hash(own, window).view(np.int64)
                    h2 = window_hash(mix(own ^ np.uint64(_SECOND)), window, _SECOND).view(np.int64)
                    start = np.arange(len(h1)) if starts is None else starts
                    h1, h2 = h1[start], h2[start]
                if first:
                    h1, h2 = np.append(h1, d1), np.append(h2, d2)
                    start = np.append(start, -1)
                for name, values in (("h1", h1), ("h2", h2), ("start", start)):
                    columns[name].append(values)
                counts.append(len(h1))
                ids.append(doc)
                digests.append(d1)
            yield _rows(columns, counts, {"doc_id": ids, "digest": digests})

    return run


def _narrow(window: int, length: int, first: bool):
    """Keep the candidate windows whose chosen shorter window survived; finish the other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        text = "text" if first else "kept"
        for batch in slices(batches, text):
            out: dict[str, list] = {k: [] for k in ("digest", "n_words", "n_removed", "kept", "runs")}
            seeds = batch.column("seeds").to_pylist()
            copy_of = batch.column("copy_of").to_pylist()
            all_runs = None if first else batch.column("runs").to_pylist()
            docs = batch.column("doc_id").to_pylist()
            for k, raw in enumerate(texts(batch.column(text))):
                words = (raw or b"").split()
                runs = np.zeros(0, np.int64)
                is_copy = copy_of[k] is not None and copy_of[k] < docs[k]
                if not is_copy and seeds[k] and len(words) >= window:
                    values = chosen(codes.of(words), window, length).view(np.int64)
                    mask = np.isin(values, np.array(seeds[k], np.int64))
                    if not first:
                        was = np.zeros(len(mask), bool)
                        was[starts_of(all_runs[k])] = True
                        mask &= was
                    runs = runs_of(mask)
                joined = b" ".join([] if is_copy else words)
                open_ = len(runs) > 0
                out["digest"].append(_digest(words)[0])
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) if is_copy else 0)
                out["kept"].append(joined if open_ else hashlib.sha256(joined).hexdigest().encode())
                out["runs"].append(runs.astype(np.int32) if open_ else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(out["digest"], pa.int64()),
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["kept"], pa.binary()).cast(pa.string()),
                    pa.array(out["runs"], pa.list_(pa.int32())),
                ],
                names=["doc_id", "digest", "n_words", "n_removed", "kept", "runs"],
            )

    return run


def _remove(window: int):
    """Take the covered words out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "kept"):
            kept, removed = [], []
            for raw, starts in zip(
                texts(batch.column("kept")), batch.column("starts").to_pylist(), strict=True
            ):
                words = raw.split()
                gone = covered(np.array(starts or [], np.int64), window, len(words))
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    batch.column("starts"),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "starts"],
            )

    return run


def repeated_passages(
    docs: DataFrame, *, window: int = WINDOW, shortest: int = SHORTEST
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, starts) for each row of `docs` (doc_id, text).

    starts has the first words of the repeated windows; it is null for a document without any and for
    one that is a copy of a smaller one as a whole (n_removed = n_words). Words are runs of anything
    but ASCII white space; a null or empty text has none. Rows with one doc_id are never repeats of
    each other; a row without doc_id loses nothing and is nobody's original. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    lengths = levels(window, shortest)
    if len(lengths) == 1:
        lengths = [max(1, window // 2), window]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))

    work, finished = rows, None
    for length in lengths[:-1]:
        first = finished is None
        found = scratch.write(work.mapInArrow(_hashes(window, length, first), ROWS), f"windows-{length}")
        shared = scratch.write(
            found.groupBy("h1", "h2")
            .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
            .filter("least < most")
            .select("h1", "h2", "least"),
            f"shared-{length}",
        )
        hits = (
            found.join(shared, ["h1", "h2"])
            .groupBy(*([] if first else ["digest"]), "doc_id")
            .agg(
                F.collect_set(F.when(F.col("start") >= 0, F.col("h1"))).alias("seeds"),
                F.min(F.when(F.col("start") < 0, F.col("least"))).alias("copy_of"),
            )
        )
        if first:
            staged = work.join(hits, "doc_id", "left")
        else:
            staged = work.join(hits, ["doc_id", "digest"], "left")
        staged = scratch.write(
            staged.mapInArrow(_narrow(window, length, first), STAGED), f"staged-{length}"
        )
        scratch.drop(f"windows-{length}", f"shared-{length}")
        done = staged.filter("runs is null").select(
            "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256")
        )
        finished = done if finished is None else finished.unionByName(done)
        work = staged.filter("runs is not null")

    found = work.mapInArrow(_hashes(window, window, False), ROWS)
    shared = scratch.write(
        found.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .select("h1", "h2", "least"),
        "shared",
    )
    starts = (
        found.join(shared, ["h1", "h2"])
        .filter("doc_id > least")
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set("start")).alias("starts"))
    )
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<int>"
    removed = (
        work.join(starts, ["doc_id", "digest"], "left").select("doc_id", "n_words", "kept", "starts")
    ).mapInArrow(_remove(window), columns)
    result = scratch.write(
        finished.withColumn("starts", F.lit(None).cast("array<int>")).unionByName(removed), "result"
    )
    scratch.drop("shared", *(f"staged-{length}" for length in lengths[:-1]))
    return result


def cut(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the passages that `repeated_passages` found in them; other columns stay.

    The white space before a removed passage stays as it is. A document that repeats a smaller one as a
    whole, or of which no word is left, goes. Texts that lose nothing are not touched.
    """

    @F.pandas_udf("string")
    def without(text: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series(
            [t if s is None else _without(t, s, window) for t, s in zip(text, starts, strict=True)], dtype=object
        )

    loss = found.filter("n_removed > 0").select(
        F.col("doc_id").alias("_id"), "starts", (F.col("n_removed") == F.col("n_words")).alias("gone")
    )
    loss = loss.select("_id", F.struct("starts", "gone").alias("_loss"))
    rows = docs.join(loss, docs["doc_id"] == loss["_id"], "left")
    rows = rows.filter(~F.coalesce(loss["_loss.gone"], F.lit(False)))
    text = F.when(loss["_loss"].isNull(), docs["text"]).otherwise(without(docs["text"], loss["_loss.starts"]))
    return rows.select(*[(text if c == "text" else docs[f"`{c}`"]).alias(c) for c in docs.columns])


def _without(text: str | None, starts: Sequence[int], window: int) -> str | None:
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    edges = runs_of(covered(np.array(starts, np.int64), window, len(spans)))
    kept, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        kept.append(raw[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(raw)
    return b"".join([*kept, raw[at:]]).decode()
