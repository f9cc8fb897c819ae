"""A small folder of tables with nulls, empty and long texts, ties, repeated rows and further columns."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def write(folder, name: str, columns: dict, types: dict) -> None:
    pq.write_table(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}), folder / f"{name}.parquet")


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("tables")
    passage, item = words(rng, 60), words(rng, 30)
    benchmark = [(0, item), (1, "one two three four five six seven"), (2, None), (3, ""), (4, "too short"), (None, words(rng, 20))]
    base = [words(rng, 120) for _ in range(12)]
    swapped = item.split()
    swapped[4], swapped[17] = "zzz", "yyy"
    near = base[0].split()
    near[60] = "changed"
    boiler = "\n".join(words(rng, 6) for _ in range(5))
    texts = [
        *base, None, "", " \t\n", base[3], base[3] + "  ", base[3].replace(" ", "\n", 3), " ".join(near), words(rng, 20) + " " + passage + " " + words(rng, 20), passage, words(rng, 9) + " " + passage,
        words(rng, 30) + " " + item + " " + words(rng, 10), words(rng, 30) + " " + " ".join(swapped), "x one two three four five six seven y", boiler + "\n" + words(rng, 8), words(rng, 8) + "\n\n" + boiler, boiler,
        "a a a a a\n" * 6, words(rng, 4000), "Licensed under the Apache License, Version 2.0.\n" + words(rng, 9), words(rng, 9) + "\nAll rights reserved.", "été ünïcode ﬁ 日本語 " * 40, "ab" * 60, "Word", "two words",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, base[3]), (None, base[5]), (None, "only here " + words(rng, 40)), (1000, words(rng, 30)), (1000, words(rng, 30))]
    n = len(rows)
    write(
        folder, "documents",
        {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [None] * n, "source": ["s"] * n, "n_chars": [1] * n, "digest": ["d"] * n, "node": [7] * n, "label": [2] * n, "hash": ["h"] * n},
        {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "digest": pa.string(), "node": pa.int64(), "label": pa.int64(), "hash": pa.string()},
    )
    write(folder, "benchmark", {"item_id": [x[0] for x in benchmark], "text": [x[1] for x in benchmark]}, {"item_id": pa.int64(), "text": pa.string()})
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>" + words(rng, 400) + "</p>"
    pages = [
        (0, "http://a.example.com/de/x?y", big), (1, "https://B.Example.net/en/1#t", big), (2, None, None), (3, "no scheme", ""), (4, "ftp://net", "WARC/1.0\r\n" + inner + big), (5, "x://sub.casino-win.example.org", inner * 40),
        (6, "http://x.org/fr/q", "WARC/1.0\r\n" * 3), (7, "http://x.org", big), (8, "http://notexample.com/de/", "é" * 700), (9, "http://u:p@a.net:80/", "é" * 700), (10, "http://a.net/\n?q", "tail\r\n\r\n"), (None, "://", big), (7, "http://x.org", big), (11, "a://b://c.net/", "s"),
    ]
    write(folder, "pages", {"page_id": [x[0] for x in pages], "url": [x[1] for x in pages], "html": [x[2] for x in pages], "file": ["f"] * len(pages), "host": ["h"] * len(pages)}, {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "file": pa.string(), "host": pa.string()})
    write(folder, "labels", {"doc_id": [1, 2, None, 3], "quality": [1, None, 1, 1], "toxic": [0, 1, 1, None]}, {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()})
    return str(folder)


@pytest.fixture(scope="session")
def empty(tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark", "labels"):
        pq.write_table(pq.read_table(f"{tables}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def by_sql():
    def run(folder: str, sql: str) -> list[tuple]:
        con = duckdb.connect()
        for name in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(r[k] for k in order) for r in got.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def rows_of():
    def run(df) -> list[tuple]:
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)

    return run
