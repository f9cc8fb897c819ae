"""Shortest paths from many sources at once, as products of tiles: Brandes' levels out and back, with no row for a pair of vertices.

Graphs that a task can hold go by `sweeps`; what follows is for larger ones.

Vertices are numbered by component and id, so that what is connected lies together. A
tile (s, b) holds the paths from 64 sources to 1024 vertices, of which only the entries
that a level has are written; an edge tile (b, c) holds the edges between two blocks.
A level is a join of tiles on b, a product in each row, and a sum of the products by
(s, c) over sorted rows, so that a task holds one tile of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, dropped, measured, sized
from meshwork.operators import sweeps
from meshwork.operators.traversal import components

#: Sources and vertices of a tile.
SOURCES, VERTICES = 64, 1024
#: Tiles that one task takes; a full one has 786 kB.
PART_TILES = 16

_TILE = "s long, b long, at binary, value binary"


def _sparse(dense: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of a tile's entries that are not zero."""
    at = np.flatnonzero(dense)
    return at.astype(np.int32).tobytes(), dense.ravel()[at].tobytes()


def _dense(at: bytes, value: bytes) -> np.ndarray:
    out = np.zeros(SOURCES * VERTICES)
    out[np.frombuffer(at, np.int32)] = np.frombuffer(value)
    return out.reshape(SOURCES, VERTICES)


def _multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's tile times its edges: what comes to block c from block b."""
    for batch in batches:
        rows, known, matrix = [], None, None
        for s, b, c, at, value, ends in batch[["s", "b", "c", "at", "value", "ends"]].itertuples(index=False):
            if known != (b, c):
                pair = np.frombuffer(ends, np.int32)
                known, matrix = (b, c), np.zeros((VERTICES, VERTICES))
                matrix[pair // VERTICES, pair % VERTICES] = 1.0
            rows.append((s, c, *_sparse(_dense(at, value) @ matrix)))
        yield pd.DataFrame(rows, columns=["s", "b", "at", "value"])


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], np.ndarray, tuple[bytes, bytes] | None]]:
    """For each (s, b) of sorted rows: the sum of its products, and the one row that states what is known of it."""
    key, total, told = None, None, None
    for batch in batches:
        for s, b, at, value, known in batch[["s", "b", "at", "value", "known"]].itertuples(index=False):
            if key != (s, b):
                if key is not None:
                    yield key, total.reshape(SOURCES, VERTICES), told
                key, total, told = (s, b), np.zeros(SOURCES * VERTICES), None
            if known:
                told = (at, value)
            else:
                total[np.frombuffer(at, np.int32)] += np.frombuffer(value)
    if key is not None:
        yield key, total.reshape(SOURCES, VERTICES), told


def _outward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles of the next level (at, value) and all that is seen with it (seen, one bit an entry)."""
    for (s, b), total, told in _groups(batches):
        seen = np.zeros(SOURCES * VERTICES, bool) if told is None else np.unpackbits(np.frombuffer(told[0], np.uint8)).astype(bool)
        total[seen.reshape(total.shape)] = 0
        at, value = _sparse(total)
        seen[np.frombuffer(at, np.int32)] = True
        yield pd.DataFrame([(s, b, at, value, np.packbits(seen).tobytes())], columns=["s", "b", "at", "value", "seen"])


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the tiles of a level (sigma): what each entry hands back, and the sum over the sources but the vertex itself."""
    for (s, b), total, told in _groups(batches):
        if told is None:
            continue
        at, sigma = np.frombuffer(told[0], np.int32), np.frombuffer(told[1])
        delta = sigma * total.ravel()[at]
        source, vertex = s * SOURCES + at // VERTICES, at % VERTICES
        other = source != b * VERTICES + vertex
        sums = np.bincount(vertex[other], delta[other], VERTICES)
        yield pd.DataFrame([(s, b, told[0], ((1 + delta) / sigma).tobytes(), sums)], columns=["s", "b", "at", "value", "sums"])


def _summed(products: DataFrame, known: DataFrame, step, schema: str, tiles: int) -> DataFrame:
    """step over the products and known rows of each (s, b)."""
    rows = products.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True)))
    return rows.repartition(max(1, -(-tiles // PART_TILES)), "s", "b").sortWithinPartitions("s", "b").mapInPandas(step, schema)


def betweenness(graph: Graph, sources: DataFrame) -> DataFrame:
    """id and the sum over sources of the share of shortest paths to other vertices that lead through it, of every vertex."""
    sweep = sweeps.Sweep(graph, components(graph), "component", "id")
    if sweep.held:
        return checkpointed(sweeps.betweenness(sweep, sources))
    number, ends = sweep.number, sweep.ends
    block, place = (lambda c: F.floor(F.col(c) / VERTICES)), (lambda c: (F.col(c) % VERTICES).cast("int"))
    pair = (place("x") * VERTICES + place("y")).alias("e")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ends=[np.asarray(e, np.int32).tobytes() for e in batch["ends"]])

    lists = ends.groupBy(block("x").alias("b"), block("y").alias("c")).agg(F.collect_list(pair).alias("ends"))  # VERTICES squared at most
    edges, (links, size) = measured(lists.mapInPandas(packed, "b long, c long, ends binary"), F.count("*"), F.sum(F.octet_length("ends")))
    back = edges.select(F.col("c").alias("b"), F.col("b").alias("c"), F.col("ends"))

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [np.frombuffer(e, np.int32) for e in batch["ends"]]
            yield batch.assign(ends=[(p % VERTICES * VERTICES + p // VERTICES).astype(np.int32).tobytes() for p in pairs])

    back = checkpointed(back.mapInPandas(turned, "b long, c long, ends binary")) if graph.directed else edges
    mean = max(1, (size or 0) // max(1, links))

    def products(level: DataFrame, through: DataFrame, tiles: int) -> DataFrame:
        dealt = level.select("s", "b", "at", "value").repartition(max(1, -(-tiles // PART_TILES)), "s", "b")
        return dealt.join(sized(through, links, mean), "b").mapInPandas(_multiplied, _TILE)

    first = sources.select("id").distinct().join(number, "id").groupBy(F.floor(F.col("n") / SOURCES).alias("s"), block("n").alias("b")).agg(F.collect_list("n").alias("ns"))

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, b, ns in batch[["s", "b", "ns"]].itertuples(index=False):
                n = np.asarray(ns)
                at = np.sort(n % SOURCES * VERTICES + n % VERTICES).astype(np.int32)
                seen = np.zeros(SOURCES * VERTICES, bool)
                seen[at] = True
                yield pd.DataFrame([(s, b, at.tobytes(), np.ones(len(at)).tobytes(), np.packbits(seen).tobytes())], columns=["s", "b", "at", "value", "seen"])

    new, all_tiles = F.sum((F.octet_length("at") > 0).cast("long")), F.count("*")
    level, (some, tiles) = measured(first.mapInPandas(started, f"{_TILE}, seen binary"), new, all_tiles)
    levels = []
    while some:
        fresh = level.where(F.octet_length("at") > 0)
        levels.append((fresh.select("s", "b", "at", "value"), some))
        known = level.select("s", "b", F.col("seen").alias("at"), F.lit(b"").alias("value"))
        level, (some, tiles) = measured(_summed(products(fresh, edges, some), known, _outward, f"{_TILE}, seen binary", tiles), new, all_tiles)
    share, shares, sums = None, 0, []
    for here, count in reversed(levels):
        given = products(share, back, shares) if share is not None else here.limit(0)
        share, shares = checkpointed(_summed(given, here, _backward, f"{_TILE}, sums array<double>", count)), count
        sums.append(share.select("b", F.posexplode("sums").alias("p", "x")).where("x <> 0").groupBy("b", "p").agg(F.sum("x").alias("x")))
    found = None
    for one in sums:
        found = one if found is None else found.unionByName(one)
    out = number.select("id", block("n").alias("b"), place("n").alias("p"))
    if found is None:
        return out.select("id", F.lit(0.0).alias("betweenness"))
    out = checkpointed(out.join(found.groupBy("b", "p").agg(F.sum("x").alias("x")), ["b", "p"], "left").select("id", F.coalesce("x", F.lit(0.0)).alias("betweenness")))
    dropped(*(here for here, _ in levels), level)
    return out
