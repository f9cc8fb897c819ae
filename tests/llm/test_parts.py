"""Parts of the operators that a query on small tables does not reach."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import decontaminate, exact_dedup, licenses, line_dedup, packing, simhash, suffix_dedup, toxicity, url_filter, warc
from meshwork.llm.common import min_labels, scratch_path


def test_colliding_digests_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "ab", "b", "bb ", "c", "c", "ccc"])], "doc_id long, text string")
    out = exact_dedup.assign(docs, digest=lambda norm: F.lit("same"))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()) == [(0, 0, 2, True), (1, 0, 2, False), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True)]


def test_state_outlives_batches_and_restarts(spark):
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    make = lambda rows: exact_dedup.arrivals(spark.createDataFrame(rows, "doc_id long, text string"))
    make([(5, "x y"), (6, "z")]).coalesce(1).write.mode("append").parquet(log)
    make([(7, "xy")]).coalesce(1).write.mode("append").parquet(log)
    frame = spark.read.parquet(log)
    first = exact_dedup.stream_state(frame, log, files_per_batch=1, state_path=state)
    assert sorted((r.group_size, r.keep_id) for r in first.collect()) == [(1, 6), (2, 5)]
    make([(1, "x  y"), (2, "z")]).coalesce(1).write.mode("append").parquet(log)
    later = exact_dedup.stream_state(frame, log, state_path=state)
    assert sorted((r.group_size, r.keep_id) for r in later.collect()) == [(2, 2), (3, 1)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 10, 38])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    words = 1 if radius <= 3 else 4
    x = rng.integers(0, 1 << 63, (150, words), dtype=np.uint64)
    x[75:] = x[:75]
    for i in range(75, 150):
        for b in rng.integers(0, 64 * words, rng.integers(0, 2 * radius + 2)):
            x[i, b // 64] ^= np.uint64(1 << int(b % 64))
    distance = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(axis=2)
    a, b = simhash.within(x, x, radius)
    assert sorted(zip(a, b, strict=True)) == sorted(zip(*np.nonzero(distance <= radius), strict=True))
    assert (simhash.roots(150, *simhash.links(x, radius)) == simhash.roots(150, *np.nonzero(distance <= radius))).all()


def test_a_large_bucket_is_dealt_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 10)
    rng = random.Random(1)
    prints = sorted({sum(1 << b for b in rng.sample(range(60), 2)) for _ in range(60)})
    nodes = spark.createDataFrame([(x, x) for x in prints], "node long, fp long")
    labels = {r.node: r.label for r in min_labels(simhash.bucket_links(nodes, simhash.bucket_keys(F.col("fp")), ["fp"], 3)).collect()}
    x = np.array(prints, np.uint64)[:, None]
    want = simhash.roots(len(prints), *simhash.links(x, 3))
    assert [labels.get(p, p) for p in prints] == [prints[k] for k in want]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    assert {(r.node, r.label) for r in min_labels(edges).collect()} == {(k, 0) for k in range(1, 41)} | {(100, 99)}


def test_payloads_come_back_whole(spark, tables):
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    warc.write_archives(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # splits fall inside records
    try:
        got = warc.read_archives(spark, path, payloads=True).select("page_id", F.decode("payload", "UTF-8")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(r.page_id, r.html or "") for r in pages.select("page_id", "html").collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_substitutions_are_tolerated_and_half_overlaps_are_not(spark):
    item = [f"w{k}" for k in range(30)]
    few, many = item.copy(), item.copy()
    few[3] = few[15] = "x"
    many[::2] = ["y"] * 15
    docs = spark.createDataFrame([(1, "a b " + " ".join(few)), (2, " ".join(many)), (3, " ".join(item[:8]))], "doc_id long, text string")
    got = decontaminate.overlaps(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)]
    assert [r.doc_id for r in decontaminate.clean(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).orderBy("doc_id").collect()] == [2, 3]


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan_places_each_document_once(seed):
    rng = random.Random(seed)
    histogram = {k: rng.randint(1, 40) for k in rng.sample(range(1, 2049), 200)}
    placed = packing.plan(histogram)
    for length, n in histogram.items():
        ranks = sorted(r for x in placed if x[0] == length for r in range(x[1], x[1] + x[2]))
        assert ranks == list(range(n))
    load: dict[int, list] = {}
    for length, _, n, first, offset in placed.tolist():
        for k in range(n):
            load.setdefault(first + k, []).append((offset, length))
    for spans in load.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(load) <= 1.02 * max(sum(k * n for k, n in histogram.items()) / 2048, 1) + sum(n for k, n in histogram.items() if k > 1024) * 0.5 + 2


@pytest.mark.parametrize("text", ["It's we'll don't", "<|endoftext|> a<|startoftext|>b", "ﬁ İstanbul ß é e\u0301 ²½", "日本語テキスト", "a\x1cb\x85c\xa0d", "12345 $%^ __x__", ""])
def test_chunks_give_the_tokenizer_s_ids(text):
    encoder = packing.encoder(packing.vocabulary_path())
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert list(encoder.encode([text.encode()])) == [want]


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(400):
        x = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))]
        assert suffix_dedup.lyndon_suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_long_texts_and_hot_anchors(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd ") for _ in range(300))
    docs = [(k, "".join(rng.choice("abcd ") for _ in range(80)) + passage + "".join(rng.choice("abcd ") for _ in range(80))) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 3)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 150)
    first, want = {}, {}
    for k, t in docs:
        x = t.encode()
        gone = bytearray(len(x))
        for q in range(len(x) - 49):
            if first.setdefault(x[q : q + 50], k) < k:
                gone[q : q + 50] = b"\1" * 50
        want[k] = bytes(b for b, g in zip(x, gone, strict=True) if not g)
    rows = [(k, 0, t.encode()) for k, t in docs]
    found = np.concatenate([np.concatenate(list(suffix_dedup.text_anchors(*r))) for r in rows])
    whole = suffix_dedup.anchors(rows)
    assert sorted(found.tolist()) == sorted(whole.tolist())
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove(frame).collect()} == want


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(4)
    terms = ["abcab", "bcabca", "aab", "cccbb", "abcabb"]
    machine = toxicity.TrieAutomaton(terms, ["zzq"])
    for _ in range(5000):
        w = "".join(rng.choice("abcz") for _ in range(rng.randint(0, 8)))
        want = 2 if w in terms or w.startswith("zzq") else 1 if any(len(t) >= toxicity.FUZZY_LENGTH and distance(w, t) == 1 for t in terms) else 0
        assert machine.match(w) == want, w


def test_held_out_accuracy_and_quotation(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judge(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.9
    scorer = toxicity.Scorer(toxicity.Model(words=["idiot"]))
    assert scorer.features("you idiot go")[1] > scorer.features('he said "idiot" once')[1] > 0
    assert scorer.features("you idoit")[0] == 0 and scorer.features("you idiott")[0] > 0


def test_rows_that_repeat_an_id_are_told_apart(spark):
    rows = [(3, "aa"), (5, "aa"), (5, "bb"), (None, "a a"), (None, "bb"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.assign(docs)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=repr) == sorted(
        [(3, None, 3, False), (5, None, 3, False), (None, None, 3, True), (5, 5, 2, True), (None, 5, 2, False), (7, 7, 2, True), (7, 7, 2, False)], key=repr
    )
    mixed = exact_dedup.assign(docs, digest=lambda norm: F.lit("same"))
    assert sorted((r.group_size, r.kept) for r in mixed.collect()) == [(2, False), (2, False), (2, True), (2, True), (3, False), (3, False), (3, True)]
    named = docs.withColumns({"place": F.lit(1), "_place": F.lit(2), "digest": F.lit("d"), "_metadata": F.lit("m")})
    left = exact_dedup.deduplicate(named)
    assert left.columns == named.columns and sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id) == [(5, "bb"), (7, "")] or left.count() == 3


def test_state_judges_later_documents_against_earlier_ones(spark):
    state = scratch_path(spark, "kept-state")
    first = spark.createDataFrame([(5, "x y"), (6, "z")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "xy"), (2, "z  "), (9, "new")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.assign(first, state_path=state).collect()) == [(5, 5, True), (6, 6, True)]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(later, state_path=state).collect()) == [(1, 5, 2, False), (2, 2, 2, True), (9, 9, 1, True)]


def test_lines_of_equal_hashes_are_compared(spark):
    texts = ["a long line of words number one\nx", "y\na long line of words number two", "a long line of words number one\nz", "p\nq\nr", "o\np\nq\nr"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc, r.s, r.n) for r in line_dedup.repeated(docs, line_hash=lambda x: F.lit(7).cast("long")).collect()}
    assert got == {(r.doc, r.s, r.n) for r in line_dedup.repeated(docs).collect()} == {(2, 0, 1), (4, 1, 3)}
    out = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.rewrite(docs.withColumn("n_runs", F.lit("was here"))).collect()}
    assert out == {0: (0, texts[0]), 1: (0, texts[1]), 2: (1, "z"), 3: (0, texts[3]), 4: (3, "o")}


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [("http://u:p@A.example.com.:80/a/./b/../c", "a.example.com", "/a/c"), ("http://x..y//p//q/", "x.y", "/p/q/"), ("http://h/%7Ea%2Fb+c", "h", "/~a/b+c"), ("http://h/%zz", "h", "/%zz"), ("http://h", "h", ""), ("http://h/..", "h", "/")],
)
def test_canonical_urls(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(url_filter.canonical_host(url_filter.host_of(F.col("url"))).alias("h"), url_filter.canonical_path(url_filter.path_of(F.col("url"))).alias("p")).first()
    assert (row.h, row.p) == (host, path)


def test_listed_urls_in_any_spelling(spark):
    listed = spark.createDataFrame([("HTTP://Bad.example.org:80/x/../y",), ("http://all.example.org",), (None,), ("",)], "url string")
    urls = ["http://bad.example.org/y", "http://bad.example.org/y/z", "http://me@bad.example.org./y?q", "http://sub.all.example.org:8080/any", "http://notall.example.org/", "http://a.net/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, listed).orderBy("page_id").collect()] == ["block", "allow", "block", "block", "allow", "block", "allow"]


def test_confirmed_licences(spark):
    wrapped = "intro.\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction.\n\nThe end."
    docs = spark.createDataFrame([(1, wrapped), (2, "Licensed under the Apache License, Version 2.0."), (3, "He lost his driving license last year and takes the bus to work.")], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    assert any(r.line is not None for r in rows)  # a wrapped licence's lines are judged too
    got = {r.doc_id: (r.family, r.coverage, r.confirmed) for r in rows if r.line is None or r.doc_id != 1}
    assert set(got) == {1, 2} and got[1][0] == "mit" and got[1][2] and got[2][0] == "apache" and got[2][2]
    for _, (family, coverage, _) in got.items():
        text = wrapped.split("\n\n")[1] if family == "mit" else "Licensed under the Apache License, Version 2.0."
        pairs = lambda t: set(zip(licenses.words_of(t), licenses.words_of(t)[1:], strict=False))
        known = {tuple(g.split()) for g in licenses.fit().vocabulary if " " in g}
        best = max(len(pairs(t) & pairs(text) & known) / max(1, len(pairs(t))) for t in licenses.TEMPLATES[family])
        own = len(pairs(text) & known & set().union(*(pairs(t) for t in licenses.TEMPLATES[family]))) / max(1, len(licenses.words_of(text)) - 1)
        assert abs(coverage - max(best, own)) < 1e-6


def test_parts_grow_with_the_corpus():
    assert suffix_dedup.parts_for(10**9) == suffix_dedup.LEAST_PARTS and suffix_dedup.parts_for(3 * 10**10) > suffix_dedup.LEAST_PARTS


@pytest.mark.parametrize("ranked", [3, 20_000])
def test_packing_ranks_long_runs_in_parts(spark, ranked):
    texts = ["same words here"] * 40 + [None, ""] * 6 + ["word " * 900] * 7 + ["word " * 3000] * 4 + [f"one of {k}" for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, "same words here"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, packing.vocabulary_path(), ranked=ranked).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter([*range(len(texts)), 5, None])
    packed = defaultdict(list)
    for r in rows:
        packed[r.sequence_id].append((r.offset, r.length))
    for places in packed.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= packing.CAPACITY
    assert sorted(packed) == list(range(len(packed)))
