"""TF-IDF weights of a corpus, against the plain formula."""

from collections import Counter
from math import log, sqrt

from starcheck.operators.corpus_pieces import weigh_corpus
from starcheck.operators.features import MAX_TERMS, corpus_weights, idf


def terms_of(text):
    words = text.split()
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def expected(texts):
    """Weights of texts by key; None is no text, but a row."""
    counts = {k: terms_of(text or "") for k, text in texts.items()}
    df = Counter(term for terms in counts.values() for term in terms)
    found = {}
    for k, terms in counts.items():
        raw = {t: tf * (log((1 + len(texts)) / (1 + df[t])) + 1) for t, tf in terms.items() if df[t] >= 2}
        found |= {(k, t): x / sqrt(sum(y * y for y in raw.values())) for t, x in raw.items()}
    return found


def close(rows, wanted):
    found = {(r["id"], r["term"]): r["weight"] for r in rows}
    assert len(rows) == len(found) and found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)


def test_no_term_is_left_out(spark):
    """All terms that two texts have are weighed, also beyond the size of a model's vocabulary."""
    text = " ".join(f"w{k:05d}" for k in range(MAX_TERMS // 2 + 500))
    texts = {0: text, 1: text, 2: "w00000 w00000 w00002 other", 3: None}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = corpus_weights(rows, "id").collect()
    assert len({r["term"] for r in found}) == MAX_TERMS + 999
    close(found, expected(texts))


def test_pieces_of_any_size(spark):
    texts = {0: "red ball red", 1: "ball red ball", 2: None, 3: "", 4: "blue sky", 5: "blue red ball", 6: "alone"}
    rows = spark.createDataFrame([(*x, False) for x in texts.items()], "id long, text string, _shared boolean")
    for words in (1, 4, 1_000):
        found = weigh_corpus(rows.coalesce(2), "id", lambda df: idf(len(texts), df), 2, words)
        close(found.collect(), expected(texts))
