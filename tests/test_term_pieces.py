"""TF-IDF of texts in pieces, against the weights of the plain formula."""

from collections import Counter
from math import log, sqrt

from starcheck.operators import term_pieces
from starcheck.operators.tfidf import batch_sizes, doc_tfidf

ROWS = [
    (1, 1, "red ball red"), (1, 2, "ball"), (1, 3, None), (1, 4, "blue red"), (1, None, "blue sky"),
    (2, 1, "red sky"), (2, 2, ""), (2, 3, "sky sky sea"), (None, 1, "red"),
]


def expected(rows):
    found = {}
    for batch in {r[0] for r in rows if r[0] is not None}:
        texts = {}
        for _, index, text in (r for r in rows if r[0] == batch):
            texts.setdefault(index, Counter()).update((text or "").split())
        n, df = sum(r[0] == batch for r in rows), Counter(term for terms in texts.values() for term in terms)
        for index, terms in texts.items():
            raw = {t: k * (log((1 + n) / (1 + df[t])) + 1) for t, k in terms.items()}
            found |= {(batch, index, t): x / sqrt(sum(y * y for y in raw.values())) for t, x in raw.items()}
    return found


def close(rows, wanted):
    found = {tuple(r)[:3]: r["weight"] for r in rows}
    assert len(rows) == len(found) and found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)


def test_weights_of_pieces(spark):
    docs = spark.createDataFrame(ROWS, "batch_id long, review_index long, text string")
    for words in (1, 4, 1_000):
        close(term_pieces.weigh_in_pieces(docs.coalesce(2), batch_sizes(docs), words).collect(), expected(ROWS))


def test_texts_are_not_taken_apart_in_shuffles(spark, monkeypatch):
    """Rows of their own go through pieces; rows that share an index are still one text."""
    used = []
    before = term_pieces.weigh_in_pieces
    monkeypatch.setattr("starcheck.operators.tfidf.weigh_in_pieces", lambda *a: used.append(1) or before(*a))
    schema = "batch_id long, review_index long, text string"
    close(doc_tfidf(spark.createDataFrame(ROWS, schema)).collect(), expected(ROWS))
    assert used == [1]
    twice = [*ROWS, (1, 2, "red sky")]
    close(doc_tfidf(spark.createDataFrame(twice, schema)).collect(), expected(twice))
    assert used == [1]
