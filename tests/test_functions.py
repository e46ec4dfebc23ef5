from pyspark.sql import functions as F

from starcheck.functions.labels import label_name, parse_label, rating_to_label
from starcheck.functions.lexicon import lexicon_confidence, lexicon_hits
from starcheck.functions.numeric import round_half_even_exact
from starcheck.functions.text import clean_text, flatten_text, terms


def test_rounding_equals_python_for_all_word_counts(spark):
    rows = []
    for p in range(41):
        for n in range(41):
            confidence = 0.5 if p == n else min(0.5 + 0.5 * abs(p - n) / (p + n), 0.99)
            for distance in (0.25, 0.5, 0.75):
                rows.append((distance * confidence, confidence))
    df = spark.createDataFrame(rows, "x double, c double").select(
        "x",
        "c",
        round_half_even_exact(F.col("x"), 3).alias("x3"),
        round_half_even_exact(F.col("c"), 2).alias("c2"),
    )
    for row in df.collect():
        assert row.x3 == round(row.x, 3)
        assert row.c2 == round(row.c, 2)


def test_python_white_space(spark):
    spaces = [chr(c) for c in range(0x11000) if chr(c).isspace()]
    assert len(spaces) == 29
    others = ["​", "﻿", "⁠", "x"]
    df = spark.createDataFrame([(c, f"a{c}b") for c in spaces + others], "c string, text string")
    for row in df.select("c", clean_text(F.col("text")).alias("clean")).collect():
        assert row.clean == ("a b" if row.c in spaces else f"a{row.c}b")


def test_clean_text(spark):
    cases = {
        "a http://x.y/z  b": "a b",
        "see(https://x.y) now": "see( now",
        "HTTP://x.y stays": "HTTP://x.y stays",
        "\t a \n\n b \u001c ": "a b",
        "http://only.link": "",
        "xhttpabc y": "x y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    for row in df.select("text", clean_text(F.col("text")).alias("clean")).collect():
        assert row.clean == cases[row.text]


def test_flatten_text_keeps_inner_space(spark):
    df = spark.createDataFrame([(" a\nb\r\n c\t\n\n",)], "text string")
    assert df.select(flatten_text(F.col("text"))).first()[0] == "a b\r  c"


def test_terms(spark):
    df = spark.createDataFrame([("A bc, Été x_1 10/10 I'm",)], "text string")
    assert df.select(terms(F.col("text"))).first()[0] == ["bc", "été", "x_1", "10", "10"]


def test_lexicon_words_are_whole_words(spark):
    cases = {
        "Great GREAT great!": ["great", "great", "great"],
        "'great' great's greatly": [],
        "broken broke, unbroken": ["broken", "broke"],
        "good-bad good_bad good1bad": ["good", "bad", "good", "bad", "good", "bad"],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    for row in df.select("text", lexicon_hits(F.col("text")).alias("hits")).collect():
        assert row.hits == cases[row.text]


def test_confidence(spark):
    df = spark.createDataFrame([(0, 0), (2, 2), (3, 1), (1, 0)], "p int, n int")
    found = [r[0] for r in df.select(lexicon_confidence(F.col("p"), F.col("n"))).collect()]
    assert found == [0.5, 0.5, 0.75, 0.99]


def test_labels(spark):
    df = spark.createDataFrame([(0.5,), (2.9,), (3.0,), (4.0,), (9.0,)], "r double")
    assert [r[0] for r in df.select(rating_to_label(F.col("r"))).collect()] == [0, 0, 1, 2, 2]
    df = spark.createDataFrame([("LABEL_2",), ("LABEL_9",), ("Positive",), ("a_b",)], "raw string")
    assert [r[0] for r in df.select(parse_label(F.col("raw"))).collect()] == [
        "positive", "label_9", "positive", "a_b",
    ]
    df = spark.createDataFrame([(0,), (3,), (-1,)], "id int")
    assert [r[0] for r in df.select(label_name(F.col("id"))).collect()] == ["negative", None, None]
