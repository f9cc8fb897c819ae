"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph ends at a blank line, or at a line's end that ends a sentence too; other
line ends are those of wrapped text. Each paragraph is judged, and each line of a
paragraph of several lines for itself as well. A multinomial logistic regression over sparse
word 1- and 2-grams, fitted on the driver on the templates and sentences below, tells
the license families and an unknown class apart. Its probabilities are calibrated by
a temperature fitted on templates and sentences of which the fit saw no form. A
prediction is confirmed where the paragraph's 2-grams cover enough of a template of
the family, or the family's templates enough of the paragraph.

Scanning uses DataFrame operations only: hashed n-grams of all paragraphs meet the
vocabulary in an equi join, and the weights are summed by paragraph. A paragraph
without any known n-gram is unknown, as the fit gives such a paragraph that class.

Defined results: null and empty texts, and empty paragraphs, have no licence;
paragraphs, and lines in them, are counted from 0 with the empty ones, line is null
for a whole paragraph of several lines; repeated rows are reported each; a
null doc_id is reported as null; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import shared_dir, sized

#: Notices of public licenses.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution and reproduction in any medium.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Sentences without a licence, some with its words.
OTHERS = (
    "He lost his driving license last year and takes the bus to work.",
    "The version of the story that the public knows is not the whole truth.",
    "A copy of the report was sent to the general at his office.",
    "The software runs on most machines without any trouble.",
    "The commons was full of students when the work was done.",
    "She has the right to be heard and the right to remain silent.",
    "The file is stored in the drawer under the desk.",
    "It is free of charge for children and the staff are friendly.",
    "The conditions on the mountain changed within the hour.",
    "They met under the bridge and talked of the weather.",
    "The terms of the peace were agreed to in writing by both kings.",
    "Any person may enter the library at any time of the day.",
    "The program on the radio was about the foundation of the city.",
    "This is the source of the river, and that is its mouth.",
    "You can use the kitchen, and you may not smoke in it.",
    "All of the guests reserved their rooms in the spring.",
    "The new law was published in the paper and in the square.",
    "The table shows the results for each of the following groups.",
    "We released the birds and watched them fly to the south.",
    "The mit of the glove is torn and the leather is old.",
)
#: Words that tell nothing by themselves or side by side.
STOP = frozenset("a all along also an and any are as at be by can copy each file following for free from general has have he if in is it its may new no not of on one or other out part person published right she so such terms that the their them they this to under up use used was we were when which who will with without work you your".split())
UNKNOWN = "unknown"
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
MIN_PROBABILITY = 0.5
#: Where one paragraph ends and the next begins.
PARAGRAPH = r"(?<=[.!?:;]\r{0,1})\n|\n(?=[ \t\r]*\n)"
#: Share of a template's 2-grams in the paragraph, or of the paragraph's in the family's templates, that confirms.
CONFIRMED = 0.6


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    vocabulary: list[str]
    weights: np.ndarray  # (families, vocabulary)
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        """Class probabilities of one paragraph; the same sums as the scan's."""
        words = words_of(text)
        index = {g: k for k, g in enumerate(self.vocabulary)}
        hit = [index[g] for g in grams_of(words) if g in index]
        z = (self.bias + self.weights[:, hit].sum(axis=1) / math.sqrt(max(1, len(words)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def examples() -> list[tuple[str, str, bool]]:
    """Templates and other sentences, whole, in stretches of words, and with every few words left out; and whether held out.

    All forms of a text are on one side: of each family's texts every third one is held out.
    """
    out = [("", UNKNOWN, False)] * 10
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for k, text in enumerate(texts):
            w = words_of(text)
            forms = [w] * 6 + [w[:k] + w[k + 1 :] for k in range(len(w)) if len(w) > 4]
            if family == UNKNOWN:
                forms += [[x] for x in w] + [w[k : k + 4] for k in range(0, len(w), 2)]
            else:
                forms += [w[k : k + 12] for k in range(0, max(1, len(w) - 11), 3) if len(w) > 14]
                forms += [["see", "below", *w], [*w, "thank", "you"]]
            out += [(" ".join(f), family, k % 3 == 1) for f in forms]
    return out


def fit(ridge: float = 0.02, rounds: int = 120) -> Model:
    """Fit the classifier on the fixed examples, after its temperature on the texts held out."""
    data = examples()
    vocabulary = sorted(g for g, n in Counter(g for t, *_ in data for g in grams_of(t.split())).items() if n > 1 and not STOP.issuperset(g.split(" ")))
    index = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(data), len(vocabulary)), np.float32)
    y = np.array([FAMILIES.index(f) for _, f, _ in data])
    for row, (text, *_) in zip(x, data, strict=True):
        words = text.split()
        row[[index[g] for g in grams_of(words) if g in index]] = 1 / math.sqrt(max(1, len(words)))
    held = np.array([h for *_, h in data])

    def descend(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(FAMILIES), x.shape[1]), np.float32), np.zeros(len(FAMILIES), np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        target = np.eye(len(FAMILIES), dtype=np.float32)[y]
        step = 4.0
        for _ in range(rounds):
            z = x @ (w + 0.9 * vw).T + b + 0.9 * vb
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
            vw = 0.9 * vw - step * (p.T @ x + ridge / len(x) * w)
            vb = 0.9 * vb - step * p.sum(axis=0)
            w, b = w + vw, b + vb
        return w, b

    w, b = descend(x[~held], y[~held])
    z = x[held] @ w.T + b

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[held]]).mean())

    temperature = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
    w, b = descend(x, y)
    if b.argmax() != FAMILIES.index(UNKNOWN):
        raise ValueError("a paragraph without known n-grams must be unknown")
    return Model(vocabulary, w, b, temperature)


def word_hashes(line: Column) -> Column:
    lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lowered, "[^a-z0-9]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def known_words(model: Model) -> list[int]:
    """Hashes of the vocabulary's single words. Every 2-gram of the vocabulary holds one of them."""
    return [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(g.encode(), 42) for g in model.vocabulary if " " not in g)]


def units(paragraph: Column, p: Column) -> Column:
    """The whole paragraph and, where it has several, its lines."""
    lines = F.split(paragraph, "\n", -1)
    each = F.transform(lines, lambda x, i: F.struct(p.alias("paragraph"), i.alias("line"), word_hashes(x).alias("w")))
    whole = F.array(F.struct(p.alias("paragraph"), F.lit(None).cast("int").alias("line"), word_hashes(paragraph).alias("w")))
    return F.when(F.size(lines) == 1, each).otherwise(F.concat(whole, each))


def paragraphs(docs: DataFrame, known: list[int]) -> DataFrame:
    """row, doc_id, paragraph, line and the word hashes of every paragraph and line that holds a known word.

    They are hashed and dismissed inside one array expression, so that one without a
    known word never becomes a row.
    """
    parts = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), PARAGRAPH, -1), units))
    telling = F.filter(parts, lambda x: F.exists(x["w"], lambda h: h.isin(known)))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(telling).alias("x")).select("row", "doc_id", "x.*")


def vocabulary_table(spark: SparkSession, model: Model) -> DataFrame:
    """gram (hash), pair (whether it has two words), weights of all families, and the templates that hold it."""
    holders: dict[str, list[int]] = {}
    for t, (_, _, text) in enumerate(template_list()):
        for g in grams_of(words_of(text)):
            holders.setdefault(g, []).append(t)
    rows = [(g.split(" "), [float(x) for x in model.weights[:, k]], holders.get(g, [])) for k, g in enumerate(model.vocabulary)]
    known = spark.createDataFrame(rows, "g array<string>, weights array<double>, templates array<int>")
    single = F.xxhash64(F.get("g", 0))
    pair = F.xxhash64(F.xxhash64(F.get("g", 0)), F.xxhash64(F.get("g", 1)))
    return known.select(F.when(F.size("g") == 2, pair).otherwise(single).alias("gram"), (F.size("g") == 2).alias("pair"), "weights", "templates")


def template_list() -> list[tuple[int, int, str]]:
    """(family, number of 2-grams, text) of every template."""
    return [(FAMILIES.index(f), max(1, len(set(zip(words_of(t), words_of(t)[1:], strict=False)))), t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph, line, family, probability, coverage and confirmed of all paragraphs that are not unknown."""
    spark = docs.sparkSession
    shared_dir(spark)
    model = model or fit()
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, rest), F.slice("w", 2, rest), lambda a, b: F.xxhash64(a, b))
    # The count is taken before the explosion, so that no array is copied to each n-gram.
    counted = paragraphs(docs, known_words(model)).select("row", "doc_id", "paragraph", "line", F.size("w").alias("n"), F.concat("w", pairs).alias("grams"))
    grams = counted.select("row", "doc_id", "paragraph", "line", "n", F.explode("grams").alias("gram"))
    known = sized(vocabulary_table(spark, model), len(model.vocabulary), 256)
    # Repeats are dropped among the few n-grams that the vocabulary holds.
    hits = grams.join(known.select("gram"), "gram", "left_semi").distinct().join(known, "gram")
    k = range(len(FAMILIES))
    templates = template_list()
    sums = [F.sum(F.get("weights", i)).alias(f"s{i}") for i in k]
    shared = [F.sum((F.col("pair") & F.array_contains("templates", t)).cast("int")).alias(f"t{t}") for t in range(len(templates))]
    in_family = [F.sum((F.col("pair") & F.arrays_overlap("templates", F.array(*(F.lit(t) for t, x in enumerate(templates) if x[0] == i)))).cast("int")).alias(f"f{i}") for i in k[:-1]]
    scored = hits.groupBy("row", "doc_id", "paragraph", "line", "n").agg(*sums, *shared, *in_family)
    z = [(F.lit(float(model.bias[i])) + F.col(f"s{i}") / F.sqrt(F.col("n").cast("double"))) / model.temperature for i in k]
    scored = scored.withColumn("z", F.array(*z)).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    scored = scored.withColumn("probability", 1 / total).withColumn("class", (F.array_position("z", F.col("top")) - 1).cast("int"))
    likely = scored.where((F.col("class") != k[-1]) & (F.col("probability") >= MIN_PROBABILITY))
    best = F.array(*(F.greatest(F.lit(0.0), *(F.col(f"t{t}") / x[1] for t, x in enumerate(templates) if x[0] == i)) for i in k[:-1]))
    own = F.array(*(F.col(f"f{i}") / F.greatest(F.col("n") - 1, F.lit(1)) for i in k[:-1]))
    coverage = F.greatest(F.get(best, F.col("class")), F.get(own, F.col("class")))
    names = F.array(*(F.lit(f) for f in FAMILIES))
    return likely.select("doc_id", "paragraph", "line", F.get(names, F.col("class")).alias("family"), F.round("probability", 6).alias("probability"), F.round(coverage, 6).alias("coverage"), (coverage >= CONFIRMED).alias("confirmed"))
