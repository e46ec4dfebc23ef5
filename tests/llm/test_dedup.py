"""Near duplicates and repeated passages against brute force."""

import hashlib

import pytest

from starcheck.llm import substring_dedup
from starcheck.llm.minhash import near_duplicates, needed_values


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def components(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("block", [3, 1024])
def test_components_are_those_of_all_pairs(docs, rows, block):
    got = near_duplicates(docs, block=block).collect()
    want = components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert max(list(c for _, c in want.values()).count(x) for x in set(c for _, c in want.values())) > 10


def test_rows_without_id_and_empty_table(null_id, no_docs, rows):
    got = near_duplicates(null_id).collect()
    assert len(got) == null_id.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {
        d: c for d, (_, c) in components(rows).items()
    }
    assert near_duplicates(no_docs).collect() == []


def test_needed_values_leave_few_pairs_out():
    assert needed_values(64, 75) == 25
    assert needed_values(1, 75) == 1


def brute(rows, window):
    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k : k + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left).hexdigest(), left)
    return out


@pytest.mark.parametrize(("window", "shortest"), [(50, 13), (8, 3), (2, 13)])
def test_passages_are_those_of_all_windows(docs, rows, window, shortest):
    got = substring_dedup.repeated_passages(docs, window=window, shortest=shortest).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3]
    assert sum(r.n_removed > 0 for r in got) > 5


def test_cut_leaves_the_other_words_and_columns(docs, rows):
    found = substring_dedup.repeated_passages(docs.dropDuplicates(["doc_id"]))
    kept = substring_dedup.cut(docs.dropDuplicates(["doc_id"]), found)
    assert kept.columns == docs.columns
    want, texts = brute(rows, 50), {r[0]: r[1] for r in rows}
    got = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == {d for d, (n, m, *_) in want.items() if n == 0 or m < n}
    for d, text in got.items():
        assert (text or "").encode().split() == want[d][3].split()
        assert want[d][1] or text == texts[d]


def test_passages_without_ids_and_empty_table(null_id, no_docs):
    got = substring_dedup.repeated_passages(null_id).collect()
    assert len(got) == null_id.count()
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substring_dedup.repeated_passages(no_docs).collect() == []


def test_levels_double():
    assert substring_dedup.levels(50, 13) == [13, 25, 50]
