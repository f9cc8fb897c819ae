"""Levels from every vertex, many sources at a time inside a task, where a task can hold the graph's arcs.

What all sources reach is a row for each pair of vertices, whatever holds it between the
levels. So groups of sources are dealt to tasks, the counted arcs are dealt to each
group through the shuffle, and a group goes all levels out and back without a table in
between: what is written grows with the arcs, not with the pairs. A task holds the arcs
of a graph of at most HELD_ARCS and the sources' state of at most CELLS numbers; larger
graphs go by `tiles` and rows of bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.statistics import in_ranges, running
from meshwork.graph import Graph, measured

#: Most arcs and vertices of a graph that a task holds, and numbers of a state (vertices times sources, or times words of 64).
HELD_ARCS, HELD_VERTICES, CELLS = 1 << 23, 1 << 20, 1 << 21
#: Arcs that all groups together are dealt, as long as there are more than LEAST_GROUPS; sources of a small group.
DEALT_ARCS, LEAST_GROUPS, SOURCES = 1 << 26, 32, 64
#: Vertices that come together when all of them take from their neighbours: their numbers stay in a processor's cache.
PULLED = 4096


class _Lists:
    """The arcs of numbered vertices by one end."""

    def __init__(self, here: np.ndarray, there: np.ndarray, n: int) -> None:
        self.to = there[np.argsort(here, kind="stable")]
        self.n, self.start = n, np.concatenate([[0], np.cumsum(np.bincount(here, minlength=n))])
        self.degree = np.diff(self.start)
        self.order = np.argsort(-self.degree, kind="stable")

    def count(self, rows: np.ndarray) -> int:
        return int(self.degree[rows].sum())

    def arcs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in rows, and other ends, of the arcs of rows."""
        d = self.degree[rows]
        place = np.repeat(np.arange(len(rows)), d)
        return place, self.to[np.arange(len(place)) + np.repeat(self.start[rows] - np.cumsum(d) + d, d)]

    def pulled(self, values: np.ndarray, fold: np.ufunc) -> np.ndarray:
        """For each vertex the fold of values over the other ends of its arcs."""
        out = np.zeros_like(values)
        taken = np.empty((PULLED, values.shape[1]), values.dtype)
        for lo in range(0, self.n, PULLED):
            rows = self.order[lo : lo + PULLED]
            start, degree = self.start[rows], self.degree[rows]
            total, k = np.zeros((len(rows), values.shape[1]), values.dtype), 0
            # The k-th arc of all that have as many, then what is left of the few with most.
            while (many := int(np.searchsorted(-degree, -k, "left"))) > 8:
                np.take(values, self.to[start[:many] + k], axis=0, out=taken[:many], mode="clip")
                fold(total[:many], taken[:many], out=total[:many])
                k += 1
            for j in range(many):
                for at in range(start[j] + k, start[j] + degree[j], PULLED):
                    total[j] = fold(total[j], fold.reduce(values[self.to[at : min(at + PULLED, start[j] + degree[j])]], axis=0))
            out[rows] = total
        return out


def _carried(rows: np.ndarray, values: np.ndarray, away: _Lists, back: _Lists, fold: np.ufunc, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some vertices, and the fold of the rows' values over the arcs that lead to them; all of wanted that such an arc reaches are among them.

    back has the arcs of away by their other ends.
    """
    most, wide = min(len(away.to) // 8, 2 * CELLS // values.shape[1]), values.shape[1]
    if (pushed := away.count(rows)) <= most:
        place, to = away.arcs(rows)
        order = np.argsort(to, kind="stable")
        at, first = np.unique(to[order], return_index=True)
        return at, fold.reduceat(values[place[order]], first, axis=0) if pushed else values[:0]
    if len(rows) == away.n:  # rows are sorted, so these are all
        dense = values
    else:
        dense = np.zeros((away.n, wide), values.dtype)
        dense[rows] = values
    if back.count(wanted) <= most:
        wanted = wanted[back.degree[wanted] > 0]
        place, of = back.arcs(wanted)
        return wanted, fold.reduceat(dense[of], np.cumsum(back.degree[wanted]) - back.degree[wanted], axis=0) if len(wanted) else values[:0]
    return np.arange(away.n), back.pulled(dense, fold)


def through(sources: np.ndarray, out: _Lists, back: _Lists) -> np.ndarray:
    """For each vertex the sum over sources of the share of shortest paths that lead through it (Brandes)."""
    shape = out.n, len(sources)
    sigma, hops, column = np.zeros(shape), np.full(shape, -1, np.int32), np.arange(len(sources))
    sigma[sources, column], hops[sources, column] = 1.0, 0
    levels = [np.unique(sources)]
    ways = sigma[levels[0]]
    while len(levels[-1]):
        at = len(levels)
        to, ways = _carried(levels[-1], ways, out, back, np.add, np.flatnonzero((hops < 0).any(axis=1)))
        whole = len(to) == out.n
        new = hops < 0 if whole else hops[to] < 0
        np.logical_and(new, ways > 0, out=new)
        np.multiply(ways, new, out=ways)
        if whole:
            sigma += ways
            np.copyto(hops, at, where=new)
        else:
            sigma[to] += ways
            hops[to] = np.where(new, at, hops[to])
        some = new.any(axis=1)
        if not some.all():
            to, ways = to[some], ways[some]
        levels.append(to)
    delta = np.zeros(shape)
    for at in range(len(levels) - 2, 0, -1):
        rows = levels[at]
        here = slice(None) if len(rows) == out.n else rows
        share = np.divide(1 + delta[here], sigma[here], out=np.zeros((len(rows), shape[1])), where=hops[here] == at)
        to, given = _carried(rows, share, back, out, np.add, levels[at - 1])
        here = slice(None) if len(to) == out.n else to
        given *= sigma[here]
        given *= hops[here] == at - 1
        delta[here] += given
    delta[sources, column] = 0.0
    return delta.sum(axis=1)


def told(sources: np.ndarray, out: _Lists, back: _Lists) -> list[tuple[int, int, int]]:
    """hops, pairs so many apart, and sources whose farthest vertex is so far, for sources with one bit each."""
    column = np.arange(len(sources))
    bits = np.uint64(1) << (column % 64).astype(np.uint64)
    seen = np.zeros((out.n, -(-len(sources) // 64)), np.uint64)
    np.bitwise_or.at(seen, (sources, column // 64), bits)
    full = np.zeros(seen.shape[1], np.uint64)
    np.bitwise_or.at(full, column // 64, bits)
    rows = np.unique(sources)
    fresh = seen[rows]
    pairs, ends = [], []
    while len(rows):
        to, met = _carried(rows, fresh, out, back, np.bitwise_or, np.flatnonzero((seen != full).any(axis=1)))
        met &= ~seen[to]
        some = met.any(axis=1)
        rows, fresh = to[some], met[some]
        seen[rows] |= fresh
        pairs.append(int(np.bitwise_count(fresh).sum()))
        ends.append(int(np.bitwise_count(np.bitwise_or.reduce(fresh, axis=0)).sum()) if len(rows) else 0)
    # A source that meets vertices at a level met some at each level before.
    return [(h + 1, pairs[h], ends[h] - ends[h + 1]) for h in range(len(pairs) - 1)]


class Sweep:
    """Numbered vertices and packed arcs of a graph; `held` tells whether a task may hold them."""

    def __init__(self, graph: Graph, ids: DataFrame, *order: str) -> None:
        by = [F.col(c) for c in order]
        numbered = running(in_ranges(ids, *by), by, F.lit(1), "n").select("id", (F.col("n") - 1).alias("n"))
        self.directed = graph.directed
        self.number, (self.n,) = measured(numbered, F.count("*"))
        arcs = graph.adjacency().where("u <> v").select("u", "v").distinct()
        self.ends = arcs.join(self.number.select(F.col("id").alias("u"), F.col("n").alias("x")), "u").join(self.number.select(F.col("id").alias("v"), F.col("n").alias("y")), "v").select("x", "y")

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(batch["x"].to_numpy(np.int32).tobytes(), batch["y"].to_numpy(np.int32).tobytes())], columns=["x", "y"])

        self.held = self.n <= HELD_VERTICES
        if self.held:
            self.arcs, (size,) = measured(self.ends.mapInPandas(packed, "x binary, y binary"), F.sum(F.octet_length("x")))
            self.m = (size or 0) // 4
            self.held = self.m <= HELD_ARCS

    def dealt(self, sources: DataFrame, at_once: int, step: Callable[[np.ndarray, _Lists, _Lists], list[tuple]], schema: str) -> DataFrame:
        """The rows that step gives for groups of sources (n), so many at once at most."""
        n, directed = self.n, self.directed
        groups = max(1, min(-(-n // SOURCES), max(LEAST_GROUPS, DEALT_ARCS // max(1, self.m))))
        mine = sources.groupBy(F.expr(f"n * {groups} div {max(1, n)}").cast("int").alias("g")).agg(F.collect_list(F.col("n").cast("int")).alias("ns"))  # HELD_VERTICES at most
        nothing = F.lit(b"")
        whole = self.arcs.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.array().cast("array<int>").alias("ns"), "x", "y")
        rows = whole.unionByName(mine.select("g", "ns", nothing.alias("x"), nothing.alias("y"))).repartition(groups, "g").sortWithinPartitions("g")

        def swept(parts: list[tuple[np.ndarray, bytes, bytes]]) -> Iterator[pd.DataFrame]:
            mine = np.sort(np.concatenate([np.asarray(ns, np.int64) for ns, _, _ in parts]))
            x, y = (np.frombuffer(b"".join(p[k] for p in parts), np.int32) for k in (1, 2))
            if len(mine):
                out = _Lists(x, y, n)
                back = _Lists(y, x, n) if directed else out
                for k in range(0, len(mine), at_once):
                    yield pd.DataFrame(step(mine[k : k + at_once], out, back), columns=[c.split()[0] for c in schema.split(", ")])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, parts = None, []
            for batch in batches:
                for g, ns, x, y in batch[["g", "ns", "x", "y"]].itertuples(index=False):
                    if g != last and parts:
                        yield from swept(parts)
                        parts = []
                    last = g
                    parts.append((ns, x, y))
            if parts:
                yield from swept(parts)

        return rows.mapInPandas(run, schema)


def betweenness(sweep: Sweep, sources: DataFrame) -> DataFrame:
    """id and betweenness of every vertex, over sources (id)."""
    wide = max(1, min(32, CELLS // max(1, sweep.n)))
    each = sources.select("id").distinct().join(sweep.number, "id").select("n")
    sums = sweep.dealt(each, wide, lambda s, out, back: [(through(s, out, back),)], "sums array<double>")
    found = sums.select(F.posexplode("sums").alias("n", "x")).where("x <> 0").groupBy("n").agg(F.sum("x").alias("x"))
    return sweep.number.join(found, "n", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("betweenness"))


def reached(sweep: Sweep) -> DataFrame:
    """hops, pairs so many hops apart, and ended: sources whose farthest vertex is so far; a row for each level of some sources."""
    wide = 64 * max(1, min(16, CELLS // max(1, sweep.n)))
    return sweep.dealt(sweep.number.select("n"), wide, told, "hops int, pairs long, ended long")
