"""License scans: units of a text are compared to license templates by Dice over word bigrams.

Units are the lines of a text, its paragraphs of several lines, and the whole text. Text is normalised to
lower-case words of letters and digits. The similarity of two sets of a and b bigrams is at most
2 * min(a, b) / (a + b), so a unit is compared only with templates of a size that can reach the threshold,
and most units have no such template and are never cut into bigrams.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcheck.functions.once import once

THRESHOLD = 0.75

# Usual wordings of license notices; fixed values of this library.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version."
    ),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
        " MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def sizes_for(n: int, threshold: float) -> tuple[int, int]:
    """The least and the most bigrams of a set that can be similar enough to one of n."""
    fits = [m for m in range(1, int(n * 2 / threshold) + 2) if 2 * min(n, m) >= threshold * (n + m)]
    return fits[0], fits[-1]


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, number, words): the normalised units of each text; numbers start at 0."""
    text = F.regexp_replace(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = rows.select(
        "doc_id", F.lit("line").alias("unit"), F.posexplode(F.split("text", "\n")).alias("number", "words")
    )
    paragraphs = rows.select(
        "doc_id",
        F.lit("paragraph").alias("unit"),
        F.posexplode(F.split("text", r"\n *\n[\n ]*")).alias("number", "words"),
    ).filter(F.contains("words", F.lit("\n")))
    whole = rows.filter(F.col("text").rlike(r"\n *\n")).select(
        "doc_id", F.lit("text").alias("unit"), F.lit(0).alias("number"), F.col("text").alias("words")
    )
    return lines.unionByName(paragraphs).unionByName(whole)


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, unit, number, license, dice, n_bigrams) of each unit that is similar to a template.

    Of several templates the most similar counts, of equally similar ones the first by name. Units of fewer
    than two words, null and empty texts have no bigrams and no match. Repeated rows give repeated matches;
    a row without doc_id is scanned too. Other columns are ignored; an empty table gives an empty result.
    """
    known = {name: template_bigrams(text) for name, text in templates.items()}
    known = {name: bigrams for name, bigrams in known.items() if bigrams}
    if not known:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).limit(0).selectExpr(
            "doc_id", "'' unit", "0 number", "'' license", "0D dice", "0 n_bigrams"
        )
    bounds = {name: sizes_for(len(b), threshold) for name, b in known.items()}
    found = units(docs)
    # Distinct bigrams are at most words - 1. So too few words are too few bigrams at once; long units are
    # counted first, as repeats may bring them back within bounds.
    count = F.regexp_count("words", F.lit(r"[^ \n]+"))
    rows = found.filter(count > min(low for low, _ in bounds.values()))
    word = F.filter(F.split("words", r"[ \n]+"), lambda w: w != "")
    rows = once(rows, word=word)
    pairs = F.zip_with(
        F.slice("word", F.lit(1), F.size("word") - 1),
        F.slice("word", F.lit(2), F.size("word") - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    rows = once(rows.drop("words"), bigrams=F.array_distinct(pairs)).drop("word")
    n = F.size("bigrams")

    def dice(name: str) -> Column:
        low, high = bounds[name]
        both = F.size(F.array_intersect("bigrams", F.array(*map(F.lit, known[name]))))
        return F.when(n.between(low, high), 2.0 * both / (n + len(known[name]))).otherwise(0.0)

    best = F.array(*[F.struct((-dice(name)).alias("d"), F.lit(name).alias("name")) for name in sorted(known)])
    rows = once(
        rows.filter(n.between(min(a for a, _ in bounds.values()), max(b for _, b in bounds.values()))),
        best=F.array_min(best),
    )
    return rows.filter(-F.col("best.d") >= threshold).select(
        "doc_id",
        "unit",
        "number",
        F.col("best.name").alias("license"),
        (-F.col("best.d")).alias("dice"),
        n.alias("n_bigrams"),
    )
