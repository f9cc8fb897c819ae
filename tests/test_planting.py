"""Decoys, citation patterns, typed paths and reach against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest

from meshwork.graph import Graph
from meshwork.operators import planting, traversal

RNG = random.Random(11)
EDGES = sorted({tuple(sorted(RNG.sample(range(1, 31), 2))) for _ in range(60)})


def draw(*what) -> float:
    return int(hashlib.md5(":".join(map(str, (42, *what))).encode()).hexdigest()[:13], 16) / (1 << 52)


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.createDataFrame(EDGES, "src long, dst long")).stored()


def test_numbers_follow_the_order(spark):
    ids = [(i, RNG.randint(0, 4)) for i in RNG.sample(range(1000), 400)]
    rows = planting.numbered(spark.createDataFrame(ids, "id long, x int").repartition(7), planting.F.col("x")).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["number"])] == [i for i, _ in sorted(ids, key=lambda r: (r[1], r[0]))]
    assert sorted(r["number"] for r in rows) == list(range(400))
    assert planting.numbered(spark.createDataFrame([], "id long")).collect() == []


@pytest.mark.parametrize("directed", [False, True])
def test_decoys_as_plain_draws(spark, graph, directed):
    ids = sorted({v for e in EDGES for v in e})
    truth = [[*EDGES[0]], [EDGES[3][1], EDGES[3][0]]]
    seen = {tuple(t) for t in truth} | (set() if directed else {tuple(reversed(t)) for t in truth})
    want = {}
    for k in range(600):
        a, b, hops = ids[int(draw(k, "from") * len(ids))], ids[int(draw(k, "to") * len(ids))], 1 + int(draw(k, "length") * 4)
        path = (a, *(max(ids) + 3 * k + i for i in range(1, hops)), b)
        if a != b and path not in seen:
            want[k] = path
            seen |= {path} if directed else {path, path[::-1]}
    wide, decoys = planting.noise(Graph(graph.edges, None, directed), spark.createDataFrame([(t,) for t in truth], "nodes array<long>"), 600)
    assert {r["k"]: tuple(r["nodes"]) for r in decoys.collect()} == want
    assert sum(len(p) == 2 for p in want.values()) > 50
    old = set(EDGES) if directed else {*EDGES, *((b, a) for a, b in EDGES)}
    fresh = {e: 0.3 * draw(*e) for p in want.values() for e in itertools.pairwise(p) if e not in old}
    got = {(r["src"], r["dst"]): r["weight"] for r in wide.edges.collect()}
    assert got == pytest.approx(dict.fromkeys(EDGES, 1.0) | fresh)
    assert wide.edges.count() == len(got)


def test_decoys_need_two_vertices(spark):
    lone = Graph(spark.createDataFrame([(5, 5)], "src long, dst long"))
    wide, decoys = planting.noise(lone, spark.createDataFrame([], "nodes array<long>"), 10)
    assert decoys.count() == 0 and wide.edges.count() == 1


@pytest.mark.parametrize("kind", planting.ARCS)
@pytest.mark.parametrize("n_mediators", [1, 3])
def test_citation_patterns(spark, kind, n_mediators):
    works = [f"w{i}" for i in range(20)]
    order = sorted(works, key=lambda w: (draw(w), w))
    third = [order[i : i + 3] for i in range(0, 18, 3)]
    if kind in planting.MEDIATED:
        third = [[order[k], f"m{k % n_mediators}", order[k + 1]] for k in range(19)]
    old = {tuple(third[1][j] for j in planting.ARCS[kind][0])}
    want, arcs, count = {}, set(old), 5
    for k, nodes in enumerate(third[:count]):
        mine = [tuple(nodes[j] for j in arc) for arc in planting.ARCS[kind]]
        if not arcs & set(mine):
            want[k] = (nodes, sum(0.5 + draw(*e) / 2 for e in mine) / 2)
        arcs |= set(mine)
    g = Graph(spark.createDataFrame(list(old), "src string, dst string"), None, True)
    mediators = spark.createDataFrame([(f"m{i}",) for i in range(n_mediators)], "id string")
    wide, made = planting.cited(g, spark.createDataFrame([(w,) for w in works], "id string"), kind, count, mediators)
    rows = made.collect()
    assert {r["k"]: r["nodes"] for r in rows} == {k: p for k, (p, _) in want.items()}
    assert {r["k"]: r["relevance"] for r in rows} == pytest.approx({k: x for k, (_, x) in want.items()})
    edges = wide.edges.collect()
    assert {(r["src"], r["dst"]) for r in edges} == arcs and len(edges) == len(arcs)
    assert {r["type"] for r in edges} == {None, planting.MEDIATED.get(kind, "cites")}


def test_citation_patterns_of_nothing(spark, graph):
    none = spark.createDataFrame([], "id long")
    for kind in planting.ARCS:
        assert planting.cited(graph, none, kind, 5, none)[1].count() == 0
    with pytest.raises(ValueError):
        planting.cited(graph, none, "author", 5)
    with pytest.raises(ValueError):
        planting.cited(graph, none, "unheard", 5)


def test_typed_paths_follow_their_template(spark, graph):
    ids = sorted({v for e in EDGES for v in e})
    of = {t: [v for v in ids if v % 3 == t] for t in range(3)}
    want: dict = {}
    for k in range(200):
        nodes = tuple(of[t][int(draw(k, j) * len(of[t]))] for j, t in enumerate((1, 0, 1)))
        if len(set(nodes)) == 3:
            want.setdefault(nodes, k)
    types = spark.createDataFrame([(v, str(v % 3)) for v in ids], "id long, type string")
    wide, made = planting.typed(graph, types, ["1", "0", "1"], 200)
    assert {tuple(r["nodes"]): r["k"] for r in made.collect()} == want
    pairs = {tuple(sorted(e)) for p in want for e in itertools.pairwise(p)}
    assert sorted((r["src"], r["dst"]) for r in wide.edges.collect()) == sorted(pairs | set(EDGES))
    with pytest.raises(ValueError):
        planting.typed(graph, types, ["1", "9"], 3)


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("depth", [None, 0, 2])
def test_reach(spark, graph, backward, depth):
    arcs = [(b, a) if backward else (a, b) for a, b in EDGES]
    seen = frontier = {EDGES[5][0], EDGES[20][1]}
    for _ in range(99 if depth is None else depth):
        frontier = {b for a, b in arcs if a in frontier} - seen
        seen = seen | frontier
    seeds = spark.createDataFrame([(EDGES[5][0],), (EDGES[20][1],), (EDGES[5][0],), (777,), (None,)], "id long")
    got = traversal.reachable(graph, seeds, backward, depth)
    assert sorted((r["src"], r["dst"]) for r in got.edges.collect()) == [e for e in EDGES if set(e) <= seen]
