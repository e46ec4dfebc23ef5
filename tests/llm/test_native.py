"""Chat windows, fingerprints, quality rules, licenses, URL filters and mixing against plain Python."""

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from starcheck.llm import chat, fingerprints, licenses, mixing, quality, url_filter
from starcheck.llm.url_labels import labelled_urls


HOSTILE = "a\\<|x <\\| </s>\\ [INST]\\\\[\\INST] <<SYS>> <s> <<|end|>\n \\"


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (40, 10), (12, 12)])
def test_windows_read_back_as_the_conversation(spark, budget, history):
    talk = [(1, 0, "system", "be kind")]
    talk += [(1, k, "assistant" if k % 2 == 0 else "user", HOSTILE * (k % 4)) for k in range(1, 150)]
    talk += [(2, None, None, None), (2, 5, "assistant", "é\n"), (2, 5, "assistant", "é\n"), (None, 1, "user", "lone")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    windows = chat.format_windows(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for conv in (1, 2, None):
        own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in talk if c == conv)
        read = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(own), hashlib.sha256(read.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = [r for r in windows.collect() if r.conv_id == 1]
    assert len(rows) > 1 or budget == 2048 and len(rows) >= 1
    for r in rows:
        assert r.text.startswith("<|start|>system<|text|>be kind<|end|>")
        assert r.n_turns == 1 or len(re.findall(r"\S+", r.text)) <= 3 * budget
    assert chat.digests(chat.format_windows(df.limit(0))).collect() == []


@pytest.mark.parametrize("head", [3, 1400, 1530, 3000])
def test_history_is_as_long_as_promised(spark, head):
    """Behind a long system turn windows are short, and the history spans many of them."""
    talk = [(1, 0, "system", "s " * head)]
    talk += [(1, k, "assistant" if k % 2 == 0 else "user", f"t{k} " * (k % 9 + 1)) for k in range(1, 300)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    starts = [0]
    for *_, text in talk:
        starts.append(starts[-1] + len(text.split()) + chat.TURN_TOKENS)
    at = 0
    for r in chat.format_windows(df).orderBy("window").collect():
        back = [k for k in range(1, at) if starts[at] - starts[k] <= chat.HISTORY]
        want = [0, *back, *range(at, at + r.n_turns)] if at else [*range(r.n_turns)]
        read = [int(t) if t else 0 for t in re.findall(r"<\|text\|>(?:t(\d+))?", r.text)]
        assert read == want and r.n_context == len(want) - r.n_turns
        at += r.n_turns
    assert at == len(talk)


def jaccard(a, b):
    a, b = (collections.Counter((t or "").encode().split()) for t in (a, b))
    both, total = sum((a & b).values()), sum((a | b).values())
    return both / total if total else 1.0


def test_fingerprints_estimate_jaccard(docs, rows, no_docs, null_id):
    got = {r.doc_id: r for r in fingerprints.with_edits(docs).collect()}
    texts = {d: t or "" for d, t, *_ in rows}
    ids = sorted(texts)
    assert set(got) == set(texts)
    off = []
    for k, d in enumerate(ids):
        text, after = texts[d], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    assert abs(sum(off) / len(off)) < 0.03
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.1
    by_text = collections.defaultdict(set)
    for d in ids:
        by_text[texts[d]].add(got[d].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    lone = [r for r in fingerprints.with_edits(null_id).collect() if r.doc_id is None]
    assert len(lone) == 1 and lone[0].near_next == 0
    assert fingerprints.with_edits(no_docs).collect() == []


def test_equal_weights_count(spark):
    """Weights matter: the estimate follows the counts and not the sets."""
    rows = [(1, "a " * 9 + "b"), (2, "a " + "b " * 9)]
    got = fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string"), samples=256)
    assert abs(got.filter("doc_id = 1").first().near_next - 2 / 18) < 0.08


def plain_statistics(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_and_base_rules(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    want = {d: plain_statistics(t) for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        n_words, *_, repeat = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert r.kept != r.base_failed
    assert quality.judge(no_docs, labels).collect() == []


def test_rules_are_learned(spark):
    """Bad texts have many symbols, or long words and repeated lines; each takes a rule of its own."""
    rows = []
    for k in range(600):
        noise, lines, size = (2, 0, 5) if k % 6 == 0 else (0, 9, 9) if k % 6 == 1 else (0, 9 * (k % 2), 5 + 4 * (k % 3 == 0))
        if k % 6 > 1 and lines and size == 9:
            lines = 0
        rows.append((k, 100 + k % 50, (100 + k % 50) * size, noise * 100, 10, lines, 0, int(k % 6 > 1)))
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, quality int"
    stats = spark.createDataFrame(rows, names)
    rules = quality.learn(stats.drop("quality"), stats.select("doc_id", "quality"))
    assert len(rules) >= 2 and max(map(len, rules)) >= 2
    wrong = stats.filter(quality.verdict(rules) != (F.col("quality") == 1)).count()
    assert wrong == 0


def test_license_units_match_templates(spark, no_docs):
    def dice(a, b):
        a, b = set(licenses.template_bigrams(a)), set(licenses.template_bigrams(b))
        return 2 * len(a & b) / (len(a) + len(b))

    lines = [*licenses.TEMPLATES.values(), "RELEASED under the   mit license!", "Licensed under CC BY NC 4.1", "no match", "", "x " * 400]
    rows = [(k, line) for k, line in enumerate(lines)] + [(90, "\n".join(lines)), (91, None), (None, lines[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit(1))
    got = licenses.scan(df).collect()
    found = {(r.doc_id, r.number): r for r in got if r.unit == "line"}
    for k, line in enumerate(lines):
        scores = {n: dice(line, t) for n, t in licenses.TEMPLATES.items()} if len(line.split()) > 1 else {}
        best = min(scores, key=lambda n: (-scores[n], n)) if scores else None
        for key in ((k, 0), (90, k)):
            if best and scores[best] >= 0.75:
                assert found[key].license == best and abs(found[key].dice - scores[best]) < 1e-12
            else:
                assert key not in found
    assert (None, 0) in found
    assert licenses.scan(no_docs).collect() == []
    for n in (1, 5, 40):
        low, high = licenses.sizes_for(n, 0.75)
        assert [m for m in range(1, 200) if 2 * min(n, m) / (n + m) >= 0.75] == list(range(low, high + 1))


def test_url_rules_and_hosts(spark):
    urls = {
        "http://A.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://x.net/": ("x.net", "/", "net/", "block"),
        "https://x.net": ("x.net", "", None, None),
        "https://phishing-net/": ("phishing-net", "/", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "ftp://example.com/de/#q": ("example.com", "/de/", "example.com/de/", "block"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "x://É.org/fr/\n/?": ("É.org", "/fr/\n/", "org/fr/", "allow"),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    model = url_filter.train(*zip(*labelled_urls(), strict=True))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in url_filter.judge(df, model).collect()}
    for k, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(df.limit(0), model).collect() == []


def test_url_model_on_held_out_hosts():
    rows = labelled_urls()
    train = [r for k, r in enumerate(rows) if (k // 2) % 4]
    test = [r for k, r in enumerate(rows) if not (k // 2) % 4]
    model = url_filter.train(*zip(*train, strict=True))
    hosts, paths, truth = zip(*test, strict=True)
    right = (url_filter._scores(model, hosts, paths) >= 0.5) == list(truth)
    assert right.mean() >= 0.8


def test_raking_meets_all_targets(spark, docs, no_docs):
    targets = {"source": 0.5, "lang": {"en": 0.5, "fr": 0.3}, "topic": 1.0}
    docs = docs.filter("text is null or length(text) < 20000")
    got = mixing.mix(docs, **targets, topic_of=F.lit("any"), budget=0.6).select("row.*", *[F.col(c).alias(f"_{c}") for c in ("topic", "tokens", "weight", "probability", "kept")]).toPandas()
    assert len(got) == docs.count()
    total = got._tokens.sum()
    assert got._tokens.tolist() == [len((t or "").encode().split()) for t in got.text]
    got["goal"] = got._tokens * got._weight
    lang = got.groupby(got.lang.fillna("?"))[["_tokens", "goal"]].sum()
    named = lang._tokens[["en", "fr"]].sum()
    assert abs(lang.goal["en"] - named * 5 / 8) < 0.01 * total
    assert abs(lang.goal["?"] - lang._tokens["?"]) < 0.01 * total
    source = got.groupby(got.source.fillna("?"))[["_tokens", "goal"]].sum()
    want = source._tokens**0.5 / (source._tokens**0.5).sum() * total
    assert (abs(source.goal - want) < 0.01 * total).all()
    assert abs((got._tokens * got._probability).sum() - 0.6 * total) < 0.01 * total
    assert got._probability.max() <= 1
    assert got.drop_duplicates(["doc_id"])._kept.sum() > 0
    assert mixing.mix(no_docs, **targets).collect() == []
