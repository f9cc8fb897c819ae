"""The near-duplicate stage against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import random

import numpy as np

from meshwork.llm import simhash


def grams(text: str) -> set[tuple]:
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def plain_components(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets, label = [(d, grams(t)) for d, t in rows], {d: d for d, _ in rows}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    return label


def near_threshold(rng: random.Random, families: int) -> list[tuple[int, str]]:
    rows = []
    for f in range(families):
        base = [f"{f}w{rng.randrange(10**6)}" for _ in range(150)]
        rows.append(" ".join(base))
        for n in (2, 3, 3, 4, 5):
            copy = base.copy()
            for at in rng.sample(range(150), n):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_links_are_those_of_exact_similarity(spark, monkeypatch):
    rows = near_threshold(random.Random(3), 40)
    want = plain_components(rows)
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == want
    monkeypatch.setattr(simhash, "CHUNK_DOCS", 2)  # groups dealt to several tasks
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_links_do_not_depend_on_the_rest_of_the_table(spark):
    rows = near_threshold(random.Random(4), 10)
    alone = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    others = [(1000 + k, f"{k} a b c d e {k}") for k in range(3000)]
    among = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows + others, "doc_id long, text string")).collect()}
    assert {d: among[d] for d in alone} == alone == plain_components(rows)


def test_pairs_at_the_threshold_share_a_key():
    rng, met = np.random.default_rng(7), 0
    for _ in range(400):
        x = rng.integers(0, 1 << 64, 500, np.uint64)
        y = x[:400]  # 400 of 500: similarity 0.8
        met += bool((simhash.band_keys(x) == simhash.band_keys(y)).any())
    assert met == 400
