"""Language identification by language-bitmask n-gram filters.

The frequent n-grams of all languages share one Bloom filter in bit-sliced form: each slot holds one
bit per language, so the bitwise "and" of a few slots says at once which languages have an n-gram.
The bits are counted per language over a whole text. A language whose filter is fuller has more false
positives; its count is corrected for them. The largest corrected share decides.

Memory is bounded for any text length: a text longer than PIECE code points is cut at a blank into pieces,
and pieces are hashed in chunks of at most CHUNK code points, whose counts are added up per text. An n-gram
holds a gap only at its ends, so a cut behind a blank changes no n-gram; only a run of PIECE signs without
a blank is cut between two signs, which changes at most 2 (N - 1) of its n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.llm.scratch import Scratch
from starcheck.llm.words import mix, slices, window_hash

UNKNOWN = "und"
N = 4
#: A language has at most 1 / MIN_SHARE n-grams of this share. This bounds what the driver collects.
MIN_SHARE = 2e-5
HASHES = 4
SLOTS_PER_GRAM = 12
#: Longest piece of a text, and most code points hashed at once (about 45 bytes each).
PIECE = 1 << 18
CHUNK = 1 << 20
#: Counts of one task are merged when they hold more n-grams than this.
MERGE_AT = 4_000_000
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The quarter of the documents that nothing is learned from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners, letters): hashed n-grams of all texts, whose they are, letters per text.

    Letters are lower-cased; all else between two words is one gap. An n-gram is n signs in a row of
    which only the first and the last may be a gap.
    """
    parts = [(t or "").lower() for t in texts]
    points = np.frombuffer(" ".join(["", *parts, ""]).encode("utf-32-le"), np.uint32)
    letter = _LETTER[points]
    owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    owner = np.append(owner, max(len(parts) - 1, 0))
    letters = np.bincount(owner, letter, len(parts)).astype(np.int64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    letter, owner = letter[keep], owner[keep]
    codes = np.where(letter, points[keep], 0).astype(np.uint64)
    keys = window_hash(codes, n)
    within = np.ones(len(keys), bool)
    for k in range(1, n - 1):
        within &= letter[k : k + len(keys)]
    return keys[within], owner[1 : 1 + len(keys)][within], letters


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Texts cut into pieces of at most PIECE code points, behind a blank where there is one."""
    parts, owners = [], []
    for i, text in enumerate(texts):
        text = text or ""
        start = 0
        while len(text) - start > PIECE:
            end = start + PIECE
            blank = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
            cut = blank + 1 if blank >= 0 else end
            parts.append(text[start:cut])
            owners.append(i)
            start = cut
        parts.append(text[start:])
        owners.append(i)
    return parts, np.array(owners, np.int64)


def ngram_chunks(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ngrams() of the texts, CHUNK code points at a time; owners and letters refer to `texts`."""
    parts, owners = _pieces(texts)
    rows = len(texts)
    group: list[int] = []
    size = 0
    for k, part in enumerate([*parts, None]):
        if group and (part is None or size + len(part) > CHUNK):
            keys, own, letters = ngrams([parts[j] for j in group], n)
            mine = owners[group]
            yield keys, mine[own], np.bincount(mine, letters, rows).astype(np.int64)
            group, size = [], 0
        if part is not None:
            group.append(k)
            size += len(part)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    codes, unique = pd.factorize(np.concatenate([u for u, _ in parts]))
    return [(unique, np.bincount(codes, np.concatenate([c for _, c in parts]), len(unique)).astype(np.int64))]


def _counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                for keys, _, _ in ngram_chunks([texts[i] for i in np.flatnonzero(langs == lang)], n):
                    codes, unique = pd.factorize(keys)
                    found.setdefault(lang, []).append((unique, np.bincount(codes)))
                if sum(len(u) for u, _ in found[lang]) > MERGE_AT:
                    found[lang] = _merge(found[lang])
        for lang, parts in found.items():
            ((unique, total),) = _merge(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(unique), pa.string()),
                    pa.array(unique.view(np.int64)),
                    pa.array(total.astype(np.int64)),
                ],
                names=["lang", "gram", "count"],
            )

    return run


class Filter:
    """A bit-sliced Bloom filter: slots of one bit per language, 64 languages a word."""

    def __init__(self, grams: dict[str, np.ndarray], hashes: int = HASHES) -> None:
        self.langs = sorted(grams)
        self.hashes = hashes
        most = max([len(g) for g in grams.values()], default=1)
        self.bits = max(10, int(np.ceil(np.log2(most * SLOTS_PER_GRAM + 1))))
        words = max(1, -(-len(self.langs) // 64))
        self.slots = np.zeros((words, 1 << self.bits), np.uint64)
        self.false = np.zeros(len(self.langs))
        for k, lang in enumerate(self.langs):
            word, bit = self.slots[k // 64], np.uint64(1 << (k % 64))
            for place in self._places(grams[lang]):
                word[place] |= bit
            self.false[k] = np.mean((word & bit) > 0) ** hashes

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        step = mix(keys ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for k in range(self.hashes):
            yield ((keys + np.uint64(k) * step) >> np.uint64(64 - self.bits)).astype(np.int64)

    def counts(self, keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many n-grams of each of n texts each language has."""
        out = np.zeros((n, len(self.langs)), np.int64)
        for w in range(len(self.slots)):
            mask = np.full(len(keys), 2**64 - 1, np.uint64)
            for place in self._places(keys):
                mask &= self.slots[w][place]
            for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                has = (mask >> np.uint64(k % 64)) & np.uint64(1)
                out[:, k] = np.bincount(owner, has, n)[:n].astype(np.int64)
        return out


def predictor(model: Filter, spark: SparkSession, *, n: int = N) -> Callable[[Column], Column]:
    """A column function: text -> struct(lang_pred, score).

    The filter that goes to the executors has a size bounded by min_share and the number of languages.
    """
    shared = spark.sparkContext.broadcast(vars(model))

    def of(texts: list[str | None], found: Filter) -> pd.DataFrame:
        rows = len(texts)
        total, letters = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        counts = np.zeros((rows, len(found.langs)), np.int64)
        for keys, owner, some in ngram_chunks(texts, n):
            total += np.bincount(owner, minlength=rows)[:rows]
            letters += some
            if found.langs:
                counts += found.counts(keys, owner, rows)
        total = np.maximum(total, 1)
        lang, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
        if found.langs:
            share = counts / total[:, None]
            share = np.clip((share - found.false) / (1 - found.false), 0, 1)
            best = share.argmax(1)
            known = letters > 0
            lang[known] = np.array(found.langs, object)[best[known]]
            score = np.where(known, share[np.arange(rows), best], 0.0)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = Filter.__new__(Filter)
        vars(found).update(shared.value)
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], names=["text"])
            done = [of(s.column("text").to_pylist(), found) for s in slices(iter([part]))]
            yield pd.concat(done, ignore_index=True) if done else of([], found)

    return predict


def learn(docs: DataFrame, *, n: int = N, min_share: float = MIN_SHARE) -> Filter:
    """The n-grams of each language, from all rows of `docs` (text, lang) that have both.

    Tasks count n-grams, so rows grow with the vocabulary and not with the text. A language keeps the
    n-grams that make up `min_share` of its n-grams or more, which are at most 1 / min_share.
    """
    rows = docs.filter("text is not null and lang is not null").select(
        F.col("text").cast("string"), F.col("lang").cast("string")
    )
    scratch = Scratch(docs.sparkSession, "language-grams")
    counts = scratch.write(
        rows.mapInArrow(_counts(n), "lang string, gram long, count long")
        .groupBy("lang", "gram")
        .agg(F.sum("count").alias("count")),
        "counts",
    )
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    kept = counts.join(totals, "lang").filter(F.col("count") >= min_share * F.col("total"))
    grams: dict[str, list[int]] = {}
    for lang, gram in kept.select("lang", "gram").toLocalIterator():
        grams.setdefault(lang, []).append(gram)
    scratch.drop("counts")
    return Filter({k: np.array(v, np.int64).view(np.uint64) for k, v in grams.items()})


def identify(docs: DataFrame, model: Filter, *, n: int = N) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text).

    A null or empty text and one without a letter is `und` with score 0, as is any text when nothing
    was learned. Ties go to the language first in the alphabet. Repeated rows are judged one by one, a
    row without doc_id is not held out, other columns are ignored, an empty table gives an empty
    result.
    """
    predict = predictor(model, docs.sparkSession, n=n)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out().alias("held_out"),
        predict(F.col("text").cast("string")).alias("found"),
    )
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
