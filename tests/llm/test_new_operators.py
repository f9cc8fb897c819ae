"""Filter audit, periodic runs and the n-gram join against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import filter_audit, jaccard_join, periodic_runs
from meshwork.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string"


def test_audit_of_awkward_rows_as_sql_says(spark, tables, by_sql, rows_of):
    assert rows_of(QUERIES["op11_filter_audit"](spark, tables)) == by_sql(tables, SQL["op11_filter_audit"])


def test_shares_are_those_of_all_orders():
    rng = random.Random(2)
    for k in (1, 3, 5):
        counts = {mask: rng.randrange(50) for mask in range(1 << k)}
        poly = filter_audit.removal_polynomial(counts, k)
        for chosen in range(1 << k):
            assert filter_audit.corner(poly, chosen) == sum(n for mask, n in counts.items() if mask & chosen)
        for i in range(k):
            removed = 0
            for order in itertools.permutations(range(k)):
                before = sum(1 << j for j in order[: order.index(i)])
                removed += sum(n for mask, n in counts.items() if mask >> i & 1 and not mask & before)
            assert filter_audit.share(poly, i) * math.factorial(k) == Fraction(removed)


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (2, "b", "x"), (None, "a", None)], DOCS).withColumns({"mask": F.lit(9), "first": F.lit(1)})
    labels = spark.createDataFrame([(2, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels, fails={"S": F.col("text") == "a"}, copies="Z").collect()
    got = {(r.part, r.filter_order, r.step): r[3:] for r in rows}
    assert got["x", "SZ", 1] == (1, 2, 0, 1, 1, 1, 3) and got["x", "SZ", 2] == (1, 0, 1, 0, 0, 0, 1)
    assert got["x", "ZS", 1] == (2, 1, 0, 0, 1, 1, 1) and got["x", "ZS", 2] == (1, 1, 1, 1, 0, 0, 3)
    assert got["", "SZ", 1] == (0, 1, 0, 1, 0, 0, 2) and len(got) == 8


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            run = w[s : e + q]
            if e > s and len(run) >= max(6, 4 * q) and all(run[p:] != run[:-p] for p in range(1, q)):
                out.append((s, len(run), q))
            s = e + 1
    return sorted(out)


def test_runs_are_those_of_all_lags():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(60)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            p = rng.randrange(1, 9)
            w = w[: rng.randrange(n)] + w[:p] * rng.randrange(1, 12) + w
        assert periodic_runs.runs_of(np.array(w, np.int64)) == plain_runs(w), w
    for k in (2, 3, 9):  # words frequent enough for the transform
        w = [rng.randrange(k) for _ in range(700)]
        w[300:400] = w[300:310] * 10
        codes = np.array(w, np.int64)
        counts = periodic_runs.matches(codes, 175)
        assert [int(c) for c in counts[1:]] == [int((codes[q:] == codes[:-q]).sum()) for q in range(1, 176)]
        assert periodic_runs.runs_of(codes) == plain_runs(w)
    assert periodic_runs.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    mixed = np.where(np.arange(300_000) < 210_000, np.arange(300_000) % 7 + 1, 0)
    assert periodic_runs.runs_of(mixed) == [(0, 210_000, 7), (210_000, 90_000, 1)]


def planted(doc_id: int | None, text: str | None) -> list[bytes]:
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id: int | None, text: str | None) -> tuple:
    w = planted(doc_id, text)
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    of = lambda x: hashlib.sha256(x).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *top, of("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), of(b" ".join(x for k, x in enumerate(w) if k not in gone))


def test_op12_equals_a_plain_version(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, tables).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in docs), key=repr)
    rng = random.Random(8)
    rows = [(k, " ".join(w for _ in range(rng.randrange(9)) for w in [rng.choice("abc") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r.n_runs for r in got) > 400


def test_runs_keep_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", 5, "r", "c", "x")], "doc_id long, text string, n_words long, runs string, collapsed string, body string")
    out = periodic_runs.find(df)
    n_words, runs, collapsed = periodic_runs.found(df.columns)
    row = out.first()
    assert row[:6] == (1, "a a a a a a b", 5, "r", "c", "x") and row[n_words] == 7 and row[collapsed] == "a b" and [tuple(r) for r in row[runs]] == [(0, 6, 1)]


def grams(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def plain_join(rows: list[tuple]) -> list[tuple]:
    sets, label = [grams(r[1]) for r in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    least = {x: min((r[0] for r, y in zip(rows, label, strict=True) if y == x and r[0] is not None), default=None) for x in label}
    return sorted(((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, label, strict=True)), key=repr)


def test_op13_equals_all_pairs_on_awkward_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_jaccard_join"](spark, tables).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join([tuple(r) for r in docs])


@pytest.mark.parametrize(("frequent", "chunk"), [(64, 1024), (2, 3)])
def test_links_near_the_threshold(spark, monkeypatch, frequent, chunk):
    """Families of copies around 0.9, of growing size, with shared passages; lists and chunks of every kind."""
    monkeypatch.setattr(jaccard_join, "LIST", frequent)
    monkeypatch.setattr(jaccard_join, "CHUNK_DOCS", chunk)
    rng, rows = random.Random(3), []
    passage = [f"p{k}" for k in range(60)]
    for f in range(25):
        base = [f"{f}w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 90, 150, 151]))] + passage * (f % 2)
        rows.append(" ".join(base))
        for n in (0, 1, 2, 2, 3, 4, 5):
            copy = base.copy()
            for at in rng.sample(range(len(base)), n):
                copy[at] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                copy = copy[: len(copy) - rng.randrange(len(copy) // 8)]
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join(rows)
    assert len({r.component_id for r in got}) > 40


def test_similar_sets_share_a_prefix_element_in_every_order():
    rng = np.random.default_rng(4)
    for _ in range(300):
        ranks = rng.integers(0, 5, 1 << jaccard_join.COUNTER_BITS).astype(np.uint32)
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 63, n // 20, np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 90 * (len(x) + len(y) - both):
            assert len(np.intersect1d(jaccard_join.prefix(x, ranks, 90), jaccard_join.prefix(y, ranks, 90)))
