"""Words and word pairs counted inside tasks, so that few rows of them are shuffled.

A task numbers the words of some texts, takes pairs as pairs of numbers and counts both with numpy. The most
frequent terms are found as in Cao and Wang, Efficient Top-K Query Calculation in Distributed Networks, PODC
2004: every task gives the leading terms of its texts and the count that all others stay within; the sums bound
the total of each term, and only terms that can be among the wanted ones are counted in all texts.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.text import terms
from starcheck.session import cut

# Words that are counted at a time; what a task holds of its texts.
WORDS = 2_000_000
# Terms a task gives of those texts, by the terms that are wanted, and the least there are.
LEADING = 3
LEAST_LEADING = 10_000
# Terms that may be among the wanted ones and so are counted again in every task.
CANDIDATES = 10

PARTIAL = "term string, df long, total long, within long"
TOTALS = "number int, df long, total long"


def pieces(rows: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """The rows of a partition, some at a time: together they have `words` words or are one row."""
    held, size = [], 0
    for some in rows:
        while some.num_rows:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(some["_words"]), 0).to_numpy(zero_copy_only=False))
            fits = int(np.searchsorted(sizes, words - size, side="right"))
            fits = max(fits, 0 if held else 1)
            if fits:
                held.append(some.slice(0, fits))
                size += int(sizes[fits - 1])
                some = some.slice(fits)
            if some.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def flat_words(piece: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The row of each word, and the words."""
    words = piece["_words"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(piece.num_rows, dtype=np.int64), sizes), words.flatten()


def per_text(row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each term below n of each row."""
    both, tf = np.unique(row * n + term, return_counts=True)
    return both // n, both % n, tf


def _leading(leading: int | None, words: int) -> Callable:
    """The most frequent terms of each piece; `within` is the count all others stay within."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(rows, words):
            row, flat = flat_words(piece)
            if not len(flat):
                continue
            known = flat.dictionary_encode()
            n, code = len(known.dictionary), known.indices.to_numpy().astype(np.int64)
            near = row[:-1] == row[1:]
            pairs = (code[:-1] * n + code[1:])[near]
            pair, pair_total = np.unique(pairs, return_counts=True)
            total = np.concatenate([np.bincount(code, minlength=n), pair_total])
            within = 0
            if leading is not None and len(total) > leading:
                within = int(np.partition(total, len(total) - leading - 1)[len(total) - leading - 1])
            given = np.flatnonzero(total > within)
            double = pair[given[given >= n] - n]
            single = given[: len(given) - len(double)]
            rank = np.full(n, -1, dtype=np.int64)
            rank[single] = np.arange(len(single))
            term, of_row = [rank[code]], [row]
            if len(double):
                at = np.minimum(np.searchsorted(double, pairs), len(double) - 1)
                term.append(np.where(double[at] == pairs, at + len(single), -1))
                of_row.append(row[:-1][near])
            term, of_row = np.concatenate(term), np.concatenate(of_row)
            kept = term >= 0
            df = np.bincount(per_text(of_row[kept], term[kept], max(len(given), 1))[1], minlength=len(given))
            names = known.dictionary
            joined = pc.binary_join_element_wise(names.take(pa.array(double // n)), names.take(pa.array(double % n)), " ")
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.concat_arrays([names.take(pa.array(single)), joined]),
                    "df": pa.array(df, pa.int64()),
                    "total": pa.array(total[given], pa.int64()),
                    "within": pa.array(np.full(len(given), within), pa.int64()),
                }
            )
            # What no term is given for counts too: it has its share in the bound of every other term.
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array([None], pa.string()), "df": pa.array([0]), "total": pa.array([0]), "within": pa.array([within])}
            )

    return count


class KnownTerms:
    """Finds given terms, words and pairs, in lists of words. The terms are bounded and go to every task."""

    def __init__(self, known: list[str]):
        parts = [term.split(" ") for term in known]
        self.words = pa.array(sorted({word for part in parts for word in part}), pa.string())
        place = {word: k for k, word in enumerate(self.words.to_pylist())}
        self.n, self.terms = max(len(place), 1), max(len(known), 1)
        keys = [place[p[0]] if len(p) == 1 else self.n + place[p[0]] * self.n + place[p[1]] for p in parts]
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.number = np.array(keys, dtype=np.int64)[order], order

    def per_text(self, piece: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the term, tf) of all known terms of a piece, in the order of the rows."""
        row, flat = flat_words(piece)
        none = np.zeros(0, dtype=np.int64)
        if not len(flat) or not len(self.keys):
            return none, none, none
        seen = flat.dictionary_encode()
        place = pc.fill_null(pc.index_in(seen.dictionary, self.words), -1).to_numpy(zero_copy_only=False)
        code = place.astype(np.int64)[seen.indices.to_numpy()]
        near = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
        alone = code >= 0
        key = np.concatenate([code[alone], self.n + (code[:-1] * self.n + code[1:])[near]])
        of_row = np.concatenate([row[alone], row[:-1][near]])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = self.keys[at] == key
        return per_text(of_row[met], self.number[at[met]], self.terms)


def words_of(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns, terms(F.col("text")).alias("_words"))


def _count_known(df: DataFrame, known: list[str], words: int) -> DataFrame:
    finder = KnownTerms(known)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(rows, words):
            _, term, tf = finder.per_text(piece)
            df = np.bincount(term, minlength=len(known))
            total = np.bincount(term, tf, minlength=len(known)).astype(np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"number": pa.array(some, pa.int32()), "df": pa.array(df[some], pa.int64()), "total": pa.array(total[some], pa.int64())}
            )

    names = df.sparkSession.createDataFrame(pa.table({"number": pa.array(range(len(known)), pa.int32()), "term": known}))
    counted = words_of(df).mapInArrow(count, TOTALS).groupBy("number").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return counted.join(F.broadcast(names), "number").select("term", "df", "total")


def frequent_terms(
    df: DataFrame, max_terms: int, min_texts: int, words: int = WORDS, least_leading: int = LEAST_LEADING
) -> DataFrame:
    """(term, df, total) of a table of texts: exact for all terms that may be among the max_terms most frequent
    ones that min_texts texts have. Other terms may be missing.
    """
    leading = max(LEADING * max_terms, least_leading)
    partial = cut(
        words_of(df).mapInArrow(_leading(leading, words), PARTIAL)
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.sum("within").alias("within"))
    )
    bound = partial.filter("term is null").agg(F.sum("within")).first()[0] or 0
    found = partial.filter("term is not null")
    if not bound:  # all terms of all texts are there
        return found.drop("within")
    wanted = found.filter(F.col("df") >= min_texts).orderBy(F.desc("total")).limit(max_terms)
    least, rows = wanted.agg(F.min("total"), F.count(F.lit(1))).first()
    if rows == max_terms and least > bound:
        # A text whose piece gave another term may hold up to `within` of it.
        possible = found.filter(F.col("total") + (F.lit(bound) - F.col("within")) >= least).select("term")
        known = [r["term"] for r in possible.limit(CANDIDATES * leading + 1).collect()]
        if len(known) <= CANDIDATES * leading:
            return _count_known(df, known, words)
    every = words_of(df).mapInArrow(_leading(None, words), PARTIAL).filter("term is not null")
    return every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
