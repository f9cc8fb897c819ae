"""Decontamination against all diagonals, in plain Python."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from meshwork.llm import decontaminate


def plain_overlaps(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        t, x = text.split(), item.split()
        w, best = min(20, len(x)), None
        for g in range(-len(x) + 1, len(t)):
            same = [0 <= g + k < len(t) and t[g + k] == x[k] for k in range(len(x))]
            for s in range(len(x) - w + 1):
                m = sum(same[s : s + w])
                if m >= math.ceil(w * 0.8) and (best is None or (m, -(g + s)) > best):
                    best = (m, -(g + s))
        if best and len(x) >= 5:
            out.add((d, i, best[0], -best[1]))
    return out


@pytest.mark.parametrize(("n", "changed"), [(5, 1), (9, 1), (11, 2), (12, 2), (15, 3), (19, 3), (20, 4)])
def test_every_tolerated_pattern_of_substitutions_is_found(spark, n, changed):
    item = [f"w{k}" for k in range(n)]
    docs = []
    for spots in itertools.combinations(range(n), changed):
        docs.append((len(docs), " ".join(["a", *("x" if k in spots else w for k, w in enumerate(item)), "b"])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {(r.doc_id, r.matches, r.doc_from) for r in got.collect()} == {(d, n - changed, 1) for d, _ in docs}


def test_overlaps_are_those_of_all_diagonals(spark):
    rng = random.Random(11)
    items = [(k, " ".join(f"{rng.choice('abcdefghijklmnop')}{k % 3}" for _ in range(n))) for k, n in enumerate((4, 5, 7, 10, 12, 15, 16, 18, 20, 30, 45))]
    docs = []
    for _, item in items:
        for rate in (0.1, 0.2, 0.25):
            t = [w if rng.random() >= rate else "zz" for w in item.split()]
            cut = rng.choice((0, 0, 1, 3))
            docs.append((len(docs), " ".join([*(["q"] * rng.randrange(3)), *t[cut:], *(["r"] * rng.randrange(3))])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "item_id", "matches", "doc_from").collect()} == plain_overlaps(docs, items)
