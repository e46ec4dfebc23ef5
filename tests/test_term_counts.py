"""Frequent terms found from the leading terms of each task."""

from collections import Counter
from random import Random

from pyspark.sql import functions as F

from starcheck.operators.features import corpus_weights, vocabulary
from starcheck.operators.term_counts import WORDS, frequent_terms


def texts(rows: int) -> list[str]:
    draw = Random(5)
    return [" ".join(f"w{int(draw.paretovariate(0.6)) % 900}" for _ in range(draw.randrange(40))) for _ in range(rows)]


def terms_of(text: str) -> list[str]:
    words = text.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_frequent_terms_are_exact(spark):
    all_texts = texts(600)
    total, df = Counter(), Counter()
    for text in all_texts:
        total.update(terms_of(text))
        df.update(set(terms_of(text)))
    wanted = sorted((t for t in total if df[t] >= 2), key=lambda t: (-total[t], t))[:30]
    rows = spark.createDataFrame([(t,) for t in [*all_texts, None, ""]], "text string").repartition(3)
    for words, leading in [(1_000, 60), (1_000, 1), (WORDS, 10_000)]:
        found = frequent_terms(rows, 30, 2, words, leading).filter("df >= 2").orderBy(F.desc("total"), "term").limit(30)
        assert [tuple(r) for r in found.collect()] == [(t, df[t], total[t]) for t in wanted]


def test_few_terms_are_shuffled(spark):
    """A task gives its leading terms alone: their rows don't grow with its texts."""
    rows = spark.createDataFrame([(t,) for t in texts(600)], "text string").coalesce(1)
    assert frequent_terms(rows, 30, 2, 2_000, 60).count() < 600


def test_rows_of_one_key_are_one_text(spark):
    rows = spark.createDataFrame(
        [(1, "red red ball"), (1, "red ball"), (None, "ball"), (None, "red"), (2, "red ball"), (3, None)], "id long, text string"
    )
    known = {r["term"]: r["df"] for r in vocabulary(rows).collect()}
    idf = {term: F.ln((1.0 + F.lit(6)) / (1.0 + F.lit(df))) + 1.0 for term, df in known.items()}
    idf = {term: spark.range(1).select(value).first()[0] for term, value in idf.items()}
    counts = {1: {"red": 3, "ball": 2, "red ball": 2}, None: {"red": 1, "ball": 1}, 2: {"red": 1, "ball": 1, "red ball": 1}}
    found = {(r["id"], r["term"]): r["weight"] for r in corpus_weights(rows, "id").collect()}
    assert len(found) == 8
    for key, of_key in counts.items():
        length = sum((n * idf[t]) ** 2 for t, n in of_key.items()) ** 0.5
        for term, n in of_key.items():
            assert abs(found[key, term] - n * idf[term] / length) < 1e-9
