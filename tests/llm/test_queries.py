"""Each registered query on tables with awkward rows, against SQL or a brute-force version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from meshwork.llm import licenses, packing, simhash
from meshwork.llm.queries import QUERIES, SQL, table


def documents(folder: str) -> list[tuple]:
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def pages(folder: str) -> list[tuple]:
    t = pq.read_table(f"{folder}/pages.parquet")
    return list(zip(t["page_id"].to_pylist(), t["url"].to_pylist(), t["html"].to_pylist(), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_decontamination", "op7_line_dedup"])
def test_awkward_rows_as_sql_says(spark, tables, by_sql, rows_of, name):
    assert rows_of(QUERIES[name](spark, tables)) == by_sql(tables, SQL[name])


@pytest.mark.parametrize("name", sorted(SQL))
def test_sf0001_as_sql_says(spark, by_sql, rows_of, name):
    folder = "/root/testdata/sf0.001"
    assert rows_of(QUERIES[name](spark, folder)) == by_sql(folder, SQL[name])


def test_op1_columns_and_range(spark, tables):
    out = QUERIES["op1_toxicity"](spark, tables)
    rows = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(documents(tables))
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op3_groups(spark, tables):
    groups = defaultdict(list)
    for doc, text in documents(tables):
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((-len(text or ""), doc is None, doc or 0))
    rows = QUERIES["op3_exact_dedup"](spark, tables).collect()
    assert len(rows) == len(documents(tables))
    kept = Counter()
    for r in rows:
        best = min(groups[r.text_sha256])
        assert r.keep_id == (None if best[1] else best[2]) and r.group_size == len(groups[r.text_sha256])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def plain_fingerprint(text: str | None, n: int) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("folder", ["tables", "/root/testdata/sf0.001"])
def test_op4_components(spark, tables, folder):
    folder = tables if folder == "tables" else folder
    docs = documents(folder)
    prints = {(d, t): plain_fingerprint(t, 3) for d, t in docs}
    nodes = sorted(set(prints.values()))
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if (x ^ y).bit_count() <= 3:
                top[find(x)] = find(y)
    least = {}
    for (d, _), x in prints.items():
        if d is not None:
            least[find(x)] = min(least.get(find(x), d), d)
    want = sorted(((d, f"{prints[d, t]:016x}", least.get(find(prints[d, t]))) for d, t in docs), key=repr)
    assert sorted((tuple(r) for r in QUERIES["op4_simhash"](spark, folder).collect()), key=repr) == want


def test_op5_round_trip(spark, tables):
    rows = pages(tables)
    same = defaultdict(list)
    for page, _, html in rows:
        if len((html or "").encode()) >= 1000:
            same[html].append(page)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        named = [x for x in same.get(html, []) if x is not None]
        first = max(named) if named else None
        again = first is not None and page != first
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    got = QUERIES["op5_warc"](spark, tables).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op8_sequences(spark, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    total = 0
    for doc, text in documents(tables):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    rows = QUERIES["op8_best_fit_packing"](spark, tables).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-total // 2048) + 2


@pytest.mark.parametrize("folder", ["tables", "/root/testdata/sf0.001"])
def test_op9_against_the_model(spark, tables, folder):
    folder = tables if folder == "tables" else folder
    model, want = licenses.fit(), []
    for doc, text in documents(folder):
        for k, paragraph in enumerate(re.split(r"(?<=[.!?:;])\n|(?<=[.!?:;]\r)\n|\n(?=[ \t\r]*\n)", text or "")):
            lines = paragraph.split("\n")
            for at, unit in [*([(None, paragraph)] if len(lines) > 1 else []), *enumerate(lines)]:
                p = model.probabilities(unit)
                if p.argmax() != len(p) - 1 and p.max() >= licenses.MIN_PROBABILITY:
                    want.append((doc, (k, at), licenses.FAMILIES[p.argmax()], round(float(p.max()), 4)))
    got = [(r.doc_id, (r.paragraph, r.line), r.family, round(r.probability, 4)) for r in licenses.scan(table(spark, folder, "documents"), model).collect()]
    assert [x[:3] for x in sorted(got, key=repr)] == [x[:3] for x in sorted(want, key=repr)]
    assert all(abs(a[3] - b[3]) < 1e-3 for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True))
    assert folder != tables or {x[2] for x in got} == {"apache", "proprietary"}


@pytest.mark.parametrize("folder", ["tables", "/root/testdata/sf0.001"])
def test_op10_against_all_strings(spark, tables, folder):
    folder = tables if folder == "tables" else folder
    docs = [(1 << 63 if d is None else d, d, (t or "").encode()) for d, t in documents(folder)]
    first = {}
    for key, _, x in sorted(docs, key=lambda r: r[0]):
        for q in range(len(x) - 49):
            first.setdefault(x[q : q + 50], key)
    want = []
    for key, doc, x in docs:
        gone = bytearray(len(x))
        for q in range(len(x) - 49):
            if first[x[q : q + 50]] < key:
                gone[q : q + 50] = b"\1" * 50
        runs = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        want.append((doc, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    got = QUERIES["op10_suffix_dedup"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_wide_fingerprints_find_near_copies(spark, tables):
    found = {r.doc_id: r.component_id for r in simhash.similar_components(table(spark, tables, "documents")).collect()}
    assert found[18] == 0  # one word of 120 differs
    assert found[15] == found[16] == found[17] == 3
    assert all(found[k] == k for k in range(12))
