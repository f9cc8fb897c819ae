"""Very long inputs, and input columns called as the operators call their own."""

from __future__ import annotations

import random
import time

from meshwork.llm import decontaminate, line_dedup, suffix_dedup, url_filter


def test_paths_of_very_many_segments(spark):
    rows = [(0, "http://a.example.com/" + "a/" * 100_000), (1, "http://a.example.com/de/" + "b/" * 100_000 + "x"), (2, "http://x.org/" + "%61//" * 2_000), (3, "http://" + "s." * 50_000 + "net/q")]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(out[k].rule, out[k].verdict) for k in range(4)] == [(None, "allow"), ("example.com/de/", "block"), (None, "allow"), ("net/", "block")]
    assert len(out[0].path) == 200_001 and len(out[3].host) == 100_003


def plain_overlaps(docs, items):
    out = {}
    for d, text in docs:
        t = text.split()
        for i, item in items:
            x = item.split()
            w = min(20, len(x))
            for diagonal in range(-len(x), len(t)):
                same = [0 <= diagonal + k < len(t) and t[diagonal + k] == x[k] for k in range(len(x))]
                for s in range(len(x) - w + 1):
                    m = sum(same[s : s + w])
                    if 5 * m >= 4 * w:
                        out[d, i] = max(out.get((d, i), (0, 0)), (m, -(diagonal + s)))
    return sorted((d, i, m, -back) for (d, i), (m, back) in out.items())


def test_very_many_diagonals_of_one_document(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "the of and " * 4_000), (1, "the of and x y"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "the of and x y"), (1, "a the of and the of")], "item_id long, text string")
    began = time.perf_counter()
    got = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    assert time.perf_counter() - began < 15
    assert got == [(0, 1, 5, -1), (1, 0, 5, 0)]
    monkeypatch.setattr(decontaminate, "CELLS", 30)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))) for k in range(12)]
    asked = [(k, " ".join(rng.choice("abc") for _ in range(n))) for k, n in enumerate((5, 7, 12, 20, 24, 31))]
    asked.append((3, "b a c a b"))  # an id that comes again with another size
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain_overlaps(rows, asked) and got.count() > 20


def clashing(spark, names: list[str], text: str):
    rows = [(k, text, *(f"{n}{k}" for n in names)) for k in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


def test_names_of_the_line_operator_as_input_columns(spark):
    names = ["_doc", "_body", "_lines", "_runs", "_filled", "_places", "_gone", "_ls", "set_aside", "doc", "body", "h", "s", "n"]
    df = clashing(spark, [*names, "n_lines"], "a line that is long enough\nand another one of them\nand a third line")
    out = line_dedup.rewrite(df)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed", "n_runs", "kept_text"]
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] and (r.n_lines, r.n_removed) == (3, 3 * (r.doc_id > 0)) and r.text.startswith("a line")


def test_names_of_the_suffix_operator_as_input_columns(spark):
    names = ["_doc", "_body", "_bytes", "_spots", "_spans", "_out", "set_aside", "doc", "body", "hash", "context"]
    df = clashing(spark, [*names, "n_bytes", "kept"], "abcdefghij" * 7 + "x")
    out = suffix_dedup.remove(df)
    assert out.columns == ["doc_id", "text", *names, "n_bytes", "n_removed", "n_spans", "kept"]
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] and (r.n_bytes, r.n_removed) == (71, 71 * (r.doc_id > 0))


def test_long_texts_through_every_text_operator(spark):
    text = "\n".join(f"line {k % 50} of a very long text" for k in range(6_000))
    docs = spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.rewrite(docs).collect()} == {0: 5_950, 1: 6_000}
    items = spark.createDataFrame([(0, "of a very long text line 7 of a very long text line 8")], "item_id long, text string")
    assert sorted((r.doc_id, r.matches) for r in decontaminate.overlaps(docs, items).collect()) == [(0, 14), (1, 14)]
