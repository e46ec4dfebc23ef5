"""Held-out accuracy of languages, exact round trips of packing."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from starcheck.llm import langid, packing
from starcheck.llm.catalog import vocabulary
from starcheck.sources.tables import load

SMALL = "/root/testdata/sf0.001"


def test_held_out_documents_get_their_language(spark):
    docs = load(spark, SMALL, "documents")
    assert docs.filter(langid.held_out()).collect()
    model = langid.learn(docs.filter(~langid.held_out()))
    got = langid.identify(docs, model).join(docs, "doc_id").filter("held_out").collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in got} == {2}
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_unknown(spark, docs, null_id, no_docs):
    model = langid.learn(docs)
    got = langid.identify(null_id, model).join(null_id.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        known = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) if known else (r.lang_pred, r.score) == ("und", 0)
    assert langid.identify(no_docs, model).collect() == []
    empty = langid.learn(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    grams = {f"l{k:02}": rng.integers(0, 2**63, 500, np.uint64) for k in range(70)}
    shared = grams["l00"][:100]
    grams["l69"] = np.concatenate([grams["l69"], shared])
    found = langid.Filter(grams).counts(shared, np.zeros(100, np.int64), 1)[0]
    assert found[0] == found[69] == 100
    assert found[1:69].max() < 10


def test_ngrams_do_not_cross_words_or_texts():
    keys, owner, letters = langid.ngrams(["Ab cd", None, "--", "abcd"], 4)
    assert letters.tolist() == [4, 0, 0, 4]
    assert owner.tolist() == [0, 0, 3, 3, 3]


def test_packing_tiles_every_document(docs, rows, no_docs):
    got = packing.pack(docs, vocabulary(), windows=4).toPandas()
    tokenizer = Tokenizer.from_file(vocabulary().path)
    tokenizer.encode_special_tokens = True
    want = {}
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append(ids)
    for d, part in got.groupby("doc_id"):
        times = len(want[d])
        tokens = sum(part.length)
        assert tokens == times * len(want[d][0])
        assert set(part.doc_tokens) == {len(want[d][0])}
        for r in part.itertuples():
            ids = want[d][0][r.start : r.start + r.length]
            assert list(r.ids) == ids
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    assert set(got.doc_id) == set(want)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
        assert part.length.sum() <= 2048
    assert packing.pack(no_docs, vocabulary()).collect() == []


def test_full_sequences_stay_out_of_the_groups(spark, monkeypatch):
    """Long documents with short tails: a group holds what is left of them and no full sequence."""
    deal_group = packing._deal_group

    def bounded(capacity):
        def run(table):
            lengths = table.column("length").to_pylist()
            assert max(lengths) < capacity and sum(lengths) <= 2 * 4 * capacity, "group is not bounded"
            return deal_group(capacity)(table)

        return run

    monkeypatch.setattr(packing, "_deal_group", bounded)
    texts = [" ".join(f"w{k * j % 97}" for j in range(3000)) for k in range(12)]
    long_docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string")
    got = packing.pack(long_docs.repartition(3), vocabulary(), capacity=64, piece=16, windows=4).toPandas()
    full = got[got.length == 64]
    assert len(full) > 500 and (full.offset == 0).all() and full.sequence_id.is_unique
    assert not set(full.sequence_id) & set(got[got.length < 64].sequence_id)
    assert got.groupby("sequence_id").length.sum().max() <= 64
    tokens = packing.Tokens(*vocabulary())
    assert got.length.sum() == sum(len(tokens.of(t)) + 1 for t in [*texts, texts[0], texts[1]])


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 513) for _ in range(300)]
    windows = packing.difference(sizes, 40)
    assert sorted(k for w in windows for k in w.items) == list(range(300))
    assert all(w.total == sum(sizes[k] for k in w.items) for w in windows)
    assert max(w.total for w in windows) - min(w.total for w in windows) < 0.02 * sum(sizes) / 40
    assert [w.total for w in packing.difference([8, 7, 6, 5, 4], 2)] == [16, 14]
    full = packing.deal(sizes, 2048)
    assert max(w.total for w in full) <= 2048
    assert packing.deal([], 2048) == []
    assert len(packing.deal([2000, 2000, 2000], 2048)) == 3


def test_both_libraries_give_the_same_tokens(rows):
    fast = packing.Tokens(*vocabulary())
    slow = packing.Tokens(vocabulary().path)
    odd = ["<|endoftext|> a", "\u3000 x\r\n\t y", "\u0661\u00b2 \U0001f600's don't", " " * 60_000 + "a", "z" * 50_000]
    for text in [*odd, *(t for _, t, *_ in rows if t)]:
        assert fast.of(text).tolist() == slow.of(text).tolist()


def test_pieces_count_as_whole_texts(monkeypatch):
    """Cut behind blanks and hashed in chunks, texts give the n-grams and letters of whole texts."""
    import collections
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdéxyzQ") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 20000))) + end for end in ("", ".", " x", "\n")]
    texts += [None, "--", "Ab cd", ""]
    keys, owner, letters = langid.ngrams(texts, 4)
    monkeypatch.setattr(langid, "PIECE", 500)
    monkeypatch.setattr(langid, "CHUNK", 2000)
    got, got_letters = collections.Counter(), np.zeros(len(texts), np.int64)
    for k, o, some in langid.ngram_chunks(texts, 4):
        got.update(zip(k.tolist(), o.tolist()))
        got_letters += some
    assert got == collections.Counter(zip(keys.tolist(), owner.tolist()))
    assert (got_letters == letters).all()


def test_a_text_of_20_mb_stays_under_400_mb():
    import tracemalloc

    text = ("lorem ipsum dolor sit amet " * 800_000)[: 20 << 20]
    tracemalloc.start()
    found = sum(len(k) for k, _, _ in langid.ngram_chunks([text], 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 10_000_000
    assert peak < 400 << 20
