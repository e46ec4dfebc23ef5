import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 300) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, odd texts, nulls and repeated rows."""
    rng = random.Random(5)
    passage = " ".join(prose(rng, 70))
    base = prose(rng, 200)
    texts = [" ".join(prose(rng, rng.randrange(20, 300))) for _ in range(20)]
    texts += [texts[0], texts[0].upper(), texts[1] + " end", " ".join(base)]
    for k in range(30):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [f"{t}\n{passage}\n{t[::-1]}" for t in texts[5:12]]
    texts += [passage, "", " \t\n", "one", "a b c", "a " * 500, "é" * 30, "\u00a0\u2003 \x1f", "x" * 5000]
    texts += [" ".join(prose(rng, 20_000, 5000)), None]
    rng.shuffle(texts)
    langs = ["en", "fr", None]
    out = [(3 * k, t, langs[k % 3], f"s{k % 4}" if k % 5 else None, None) for k, t in enumerate(texts)]
    return [*out, out[4], out[9]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same with columns of names that operators use themselves, which must not matter."""
    df = spark.createDataFrame(rows, DOCS)
    names = ["starts", "kept", "_gone", "tokens", "weight", "row", "seeds", "group", "d1", "held_out"]
    return df.selectExpr("*", *[f"'x' as `{n}`" for n in names]).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def null_id(spark, docs):
    """Rows without an id beside the others."""
    return docs.unionByName(docs.filter("doc_id < 30").selectExpr("cast(null as long) doc_id", *[f"`{c}`" for c in docs.columns[1:]]))
