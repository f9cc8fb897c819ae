"""Modules, trees of clusters, partitions, certificates and feedback expansion against plain Python on small graphs."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed
from meshwork.operators import certificates, communities, expansion, flow, hierarchy, layout, spectral
from meshwork.operators.traversal import min_labels

RNG = random.Random(4)
CLIQUES = [(a + 10 * k, b + 10 * k, RNG.randint(1, 99)) for k in range(3) for a, b in itertools.combinations(range(10), 2) if RNG.random() < 0.7] + [(0, 10, 50), (11, 20, 60), (21, 1, 70)]


@pytest.fixture(scope="module")
def cliques(spark):
    return Graph(spark.createDataFrame(CLIQUES, "src long, dst long, w long")).stored()


def adjacency(rows) -> dict[int, set[int]]:
    out = defaultdict(set)
    for a, b, *_ in rows:
        out[a].add(b)
        out[b].add(a)
    return out


def plogp(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def bits(p: dict, f: dict, module: dict) -> float:
    q, v = defaultdict(float), defaultdict(float)
    for (a, b), x in f.items():
        if module[a] != module[b]:
            q[module[a]] += x
    for a, x in p.items():
        v[module[a]] += x
    return plogp(sum(q.values())) - 2 * sum(map(plogp, q.values())) - sum(map(plogp, p.values())) + sum(plogp(q[m] + v[m]) for m in v)


def plain_level(p: dict, f: dict) -> dict:
    """The rounds of one level by full evaluation of every move."""
    module, disjoint, r = {v: v for v in p}, False, 0
    near = adjacency(f)
    length = bits(p, f, module)
    while True:
        best = {}
        for v in p:
            tried = [(round(bits(p, f, module | {v: m}) - length, 12), m) for m in {module[u] for u in near[v]} if m != module[v]]
            if tried and min(tried)[0] < -flow.LEAST_GAIN:
                best[v] = min(tried)
        if not best:
            return module
        if disjoint:
            first = {}
            for v, (d, m) in best.items():
                for touched in (m, module[v]):
                    first[touched] = min(first.get(touched, (9, 0)), (d, v))
            moves = {v: m for v, (d, m) in best.items() if first[m] == first[module[v]] == (d, v)}
        else:
            moves = {v: m for v, (d, m) in best.items() if zlib.crc32(f"{v}:{r}".encode()) % 2 == 0}
        after = bits(p, f, module | moves)
        if after < length - flow.LEAST_GAIN:
            module, length = module | moves, after
        elif disjoint:
            return module
        else:
            disjoint = True
        r += 1


def test_infomap_is_the_plain_rounds(spark, cliques):
    visits, steps = flow.flows(cliques)
    p, f = {r.id: r.p for r in visits.collect()}, {(r.u, r.v): r.f for r in steps.collect()}
    assert sum(p.values()) == pytest.approx(1) and len(p) == 30
    found = {r.id: r.module for r in flow.infomap(cliques, levels=1).collect()}
    assert found == plain_level(p, f)
    assert bits(p, f, found) < bits(p, f, dict.fromkeys(p, 0))
    row = flow.description_length(visits, steps, spark.createDataFrame(list(found.items()), "id long, module long")).first()
    assert row.bits == pytest.approx(bits(p, f, found)) and row.modules == len(set(found.values()))


def test_levels_of_infomap_shorten_the_description(spark):
    ring = [(5 * k + a, 5 * k + b, 1) for k in range(4) for a, b in itertools.combinations(range(5), 2)] + [(5 * k, (5 * k + 5) % 20, 1) for k in range(4)]
    g = Graph(spark.createDataFrame(ring, "src long, dst long, w long"))
    found = defaultdict(set)
    for r in flow.infomap(g).collect():
        found[r.module].add(r.id)
    assert sorted(map(sorted, found.values())) == [list(range(5 * k, 5 * k + 5)) for k in range(4)]


def test_flow_of_a_directed_graph(spark):
    g = Graph(spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0), (1, 0, 1.0)], "src long, dst long, w double"), spark.range(3), True)
    visits, steps = flow.flows(g, "w")
    p = {r.id: r.p for r in visits.collect()}
    want = {v: 1 / 3 for v in range(3)}
    for _ in range(200):
        lost = want[2]
        want = {v: 0.05 + 0.85 * (lost / 3 + {0: want[1], 1: 0.75 * want[0], 2: 0.25 * want[0]}[v]) for v in range(3)}
    assert p == pytest.approx(want, abs=1e-6)
    assert {(r.u, r.v): r.f for r in steps.collect()} == pytest.approx({(0, 1): 0.75 * p[0], (0, 2): 0.25 * p[0], (1, 0): p[1]})


def plain_tree(rows, linkage: str) -> set:
    """(members, height) of the clusters that greedy merging makes, without what no edge joins."""
    top = max(w for *_, w in rows)
    sim = {frozenset(x[:2]): x[2] / top for x in rows}
    parts = [frozenset([v]) for v in sorted({v for a, b, _ in rows for v in (a, b)})]
    near = {"average": lambda s: sum(s) / len(s), "complete": min, "single": max}[linkage]
    out = set()
    while True:
        tried = [(-near([sim.get(frozenset((u, v)), 0.0) for u in a for v in b]), min(a), min(b), a, b) for a, b in itertools.combinations(sorted(parts, key=min), 2)]
        tried = [x for x in tried if x[0] < 0]
        if not tried:
            return out
        d, _, _, a, b = min(tried, key=lambda x: x[:3])
        parts = [x for x in parts if x not in (a, b)] + [a | b]
        out.add((a | b, round(1 + d, 9)))


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_trees_are_those_of_greedy_merging(spark, linkage):
    rng = random.Random(6)
    rows = [(a, b, w) for (a, b), w in zip(itertools.combinations(range(14), 2), rng.sample(range(1, 10_000), 91), strict=True) if rng.random() < 0.5]
    got = hierarchy.dendrogram(Graph(spark.createDataFrame(rows, "src long, dst long, w long")), linkage, "w").orderBy("round", "a").collect()
    members, made = {v: frozenset([v]) for v in range(14)}, set()
    for r in got:
        members[r.a] |= members[r.b]
        if r["size"] is not None:
            assert len(members[r.a]) == r["size"]
            made.add((members[r.a], round(r.height, 9)))
    assert made == plain_tree(rows, linkage) and len(got) == 13


def test_single_linkage_cut_is_the_components(spark, cliques):
    tree = hierarchy.dendrogram(cliques, "single", "w")
    assert tree.count() == 29
    top = max(w for *_, w in CLIQUES)
    for height in (0.2, 0.5, 0.9):
        label = {v: v for v in adjacency(CLIQUES)}
        for a, b, w in CLIQUES:
            if 1 - w / top <= height:
                low, high = sorted((label[a], label[b]))
                label = {v: low if x == high else x for v, x in label.items()}
        assert {r.id: r.cluster for r in hierarchy.clusters_at(cliques, tree, height).collect()} == label


def test_spectral_parts_are_the_cliques(spark, cliques):
    points, values = spectral.embedding(cliques, 3)
    n = sorted(adjacency(CLIQUES))
    a = np.zeros((30, 30))
    for x, y, _ in CLIQUES:
        a[n.index(x), n.index(y)] = a[n.index(y), n.index(x)] = 1
    d = a.sum(axis=0)
    want = np.linalg.eigvalsh(np.eye(30) - a / np.sqrt(np.outer(d, d)))[:3]
    assert values == pytest.approx(want, abs=1e-3)
    parts = spectral.partition(cliques, 3)
    found = {r.id: r.part for r in parts.collect()}
    assert len({found[v] for v in range(10)}) == 1 and len(set(found.values())) == 3 and sorted(map(list(found.values()).count, range(3))) == [10, 10, 10]
    assert {(r["size"], r.cut, r.balance) for r in spectral.partition_report(cliques, parts).collect()} == {(10, 2, 1.0)}
    uneven = spark.range(100).select("id", F.when(F.col("id") < 90, 0).when(F.col("id") < 95, 1).otherwise(2).alias("part"))
    sizes = sorted(r["count"] for r in spectral.balanced(uneven, 3).groupBy("part").count().collect())
    assert sum(sizes) == 100 and sizes[-1] <= 40


def test_modularity_of_louvain_and_leiden(spark, cliques):
    for find in (communities.louvain, communities.leiden):
        found = find(cliques)
        assert found.count() == 30 and communities.modularity(cliques, found).first().modularity > 0.5


def test_cycles_are_walks_along_edges(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(50, 50), (60, 61), (61, 62), (62, 60), (63, 60)}
    found = defaultdict(dict)
    for r in certificates.cycles(Graph(spark.createDataFrame(sorted(edges), "src long, dst long"), None, True)).collect():
        found[r.cycle][r.position] = r.id
    assert found[50] == {0: 50} and found[60] == {0: 60, 1: 61, 2: 62} and len(found) > 2
    for first, at in found.items():
        ring = [at[k] for k in range(len(at))]
        assert ring[0] == first == min(ring) and all((a, b) in edges for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert certificates.cycles(Graph(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), None, True)).count() == 0


def test_certificate_keeps_small_cuts(spark, cliques):
    rows = certificates.sparse_certificate(cliques, 3).collect()
    kept = {(r.src, r.dst) for r in rows}
    assert len(kept) == len(rows) and kept <= {tuple(sorted(x[:2])) for x in CLIQUES} and len([r for r in rows if r.forest == 1]) == 29
    for side in ([0], range(10), range(20), [15, 17], [3, 4, 5]):
        cut = lambda es: sum((a in side) != (b in side) for a, b in es)  # noqa: B023, E731
        assert min(3, cut({tuple(sorted(x[:2])) for x in CLIQUES})) == min(3, cut(kept))
    bounds = certificates.edge_connectivity_bounds(cliques, 3).first()
    assert 1 <= bounds.at_least <= bounds.at_most == min(map(len, adjacency(CLIQUES).values()))


def test_colours_of_a_path_and_a_ring(spark):
    path = certificates.colour_classes(Graph(spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")))
    assert {r.id: r.colour for r in path.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2, 5: 1, 6: 0}
    ring = certificates.colour_classes(Graph(spark.createDataFrame([(k, (k + 1) % 7) for k in range(7)], "src long, dst long")))
    assert {r.colour for r in ring.collect()} == {0}


def test_orientations_triples_and_elimination(spark):
    make = lambda es: Graph(spark.createDataFrame(es, "src long, dst long"))
    conflicts = lambda es: {tuple(r) for r in certificates.orientation_conflicts(certificates.forced_arcs(make(es))).collect()}
    ring5 = [(k, (k + 1) % 5) for k in range(5)]
    assert conflicts([(0, 1), (1, 2), (2, 3), (3, 0)]) == set() and conflicts(ring5) == {tuple(sorted(e)) for e in ring5}
    spider = [(0, 1), (1, 2), (0, 3), (3, 4), (0, 5), (5, 6)]
    assert [tuple(r) for r in certificates.asteroidal_triples(make(spider)).collect()] == [(2, 4, 6)]
    assert certificates.asteroidal_triples(make([(k, k + 1) for k in range(6)])).count() == 0
    width = lambda es: certificates.elimination(make(es)).agg(F.max("degree")).first()[0]
    assert width(spider) == 1 and width(ring5) == 2 and width([(a, b) for a, b in itertools.combinations(range(6), 2)]) == 5


def plain_triples(edges) -> set:
    """a < b < c of which each two are in one component of what is left without the third and its neighbours."""
    near = adjacency(edges)
    part = {}
    for x in near:
        part[x] = {}
        for v in sorted(set(near) - near[x] - {x}):
            reach = [] if v in part[x] else [v]
            while reach:
                u = reach.pop()
                part[x][u] = v
                reach += [w for w in near[u] if w != x and w not in near[x] and w not in part[x]]
    sees = lambda x, y, z: y in part[x] and z in part[x] and part[x][y] == part[x][z]
    return {(a, b, c) for a, b, c in itertools.combinations(sorted(near), 3) if sees(a, b, c) and sees(b, a, c) and sees(c, a, b)}


def test_triples_take_no_row_for_each_edge_away_from_a_vertex(spark, monkeypatch):
    rng = random.Random(5)
    dense = [(a, b) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.1]
    tree = [(100 + v, 100 + rng.randrange(max(0, v - 5), v)) for v in range(1, 30)]
    path = [(k, k + 1) for k in range(200, 230)] + [(215, 300), (300, 301)]  # longer than the rounds by bits
    edges = dense + tree + path
    ties = []
    monkeypatch.setattr(certificates, "min_labels", lambda e: (ties.append(e.count()), min_labels(e))[1])
    found = [tuple(r) for r in certificates.asteroidal_triples(Graph(spark.createDataFrame(edges, "src long, dst long"))).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_triples(edges)
    assert sum(ties) < 10_000  # 28,944 edges away from a vertex, each a row before


def plain_elimination(edges) -> set:
    """(id, round, degree) when one round after the other is played."""
    near, out, r = {v: set(ns) for v, ns in adjacency(edges).items()}, set(), 0
    while near:
        r += 1
        key = {v: (len(ns), v) for v, ns in near.items()}
        for v in [v for v, ns in near.items() if all(key[v] < key[w] for w in ns)]:
            out.add((v, r, key[v][0]))
            for w in near[v]:
                near[w] = (near[w] | near[v]) - {v, w}
            del near[v]
    return out


def test_cliques_are_eliminated_at_once(spark, monkeypatch):
    ring = [(k, (k + 1) % 6) for k in range(6)]
    clique = [(a, b) for a, b in itertools.combinations(range(20, 60), 2)]
    part = [(a, b) for a, b in itertools.combinations(range(60, 72), 2) if b - a != 6]
    edges = ring + clique + part + [(80, 81), (59, 90), (90, 91)]
    tables = []
    monkeypatch.setattr(certificates, "checkpointed", lambda df: (tables.append(1), checkpointed(df))[1])
    found = {tuple(r) for r in certificates.elimination(Graph(spark.createDataFrame(edges, "src long, dst long"))).collect()}
    assert found == plain_elimination(edges)
    assert len(tables) < 60  # four in each of some 40 rounds before


def plain_feedback(edges, seeds, order: str) -> dict:
    """(query, seed, id) to (parent, depth, round) of the banded rounds with feedback from the paths found."""
    near = adjacency(edges)
    floor_log = lambda x: (math.floor(round(x, 9)) + 1).bit_length() - 1
    owned = {(q, s, s): (None, 0, 0, (s,)) for q, s in seeds}
    done, feedback, r = set(), {}, 0
    while open_rows := {k for k in owned if k not in done}:
        r += 1
        band = {}
        for q, s, v in open_rows:
            d, fb = len(near[v]), feedback.get((q, v), 0.0)
            if order == "retrospective":
                band[q, s, v] = floor_log(4 * d * (1 - fb))
            else:
                potential = len({u for u in near[v] if any((q, t, u) in owned for x, t in seeds if x == q and t != s)})
                band[q, s, v] = floor_log(4 * d / (1 + potential) / (1 + fb))
        now = {k for k in open_rows if band[k] == min(b for x, b in band.items() if x[0] == k[0])}
        fresh = defaultdict(list)
        for q, s, v in now:
            for u in near[v]:
                if (q, s, u) not in owned:
                    fresh[q, s, u].append((owned[q, s, v][1] + 1, v, (*owned[q, s, v][3], u)))
        for k, tried in fresh.items():
            depth, parent, trail = min(tried)
            owned[k] = (parent, depth, r, trail)
        done |= now
        for (q, s, v), (_, _, rs, x) in list(owned.items()):
            for (p, t, w), (_, _, rt, y) in list(owned.items()):
                nodes = (*x, *y[::-1][1:])
                if p == q and w == v and s < t and r in (rs, rt) and len(set(nodes)) == len(nodes):
                    value = min(1.0, math.exp(sum(-math.log(math.log(len(near[n]) + 2)) for n in nodes) / len(nodes)))
                    for n in near:
                        both = len(near[n] & set(nodes))
                        if order == "retrospective":
                            got = both / len(near[n] | set(nodes)) if both else 0.0
                        else:
                            got = value if n in nodes else value / 2 if both else 0.0
                        feedback[q, n] = max(feedback.get((q, n), 0.0), got)
    return {k: v[:3] for k, v in owned.items()}


@pytest.mark.parametrize("order", ["retrospective", "adaptive"])
def test_feedback_orders_are_the_plain_rounds(spark, cliques, order):
    seeds = [(0, 3), (0, 24), (1, 12), (1, 7), (1, 29)]
    owned = expansion.expand(cliques, spark.createDataFrame(seeds, "query long, seed long"), order)
    assert {tuple(r[:3]): tuple(r[3:]) for r in owned.collect()} == plain_feedback(CLIQUES, seeds, order)


def test_adaptive_order_stops_when_its_paths_settle(spark):
    rows = [("a", k, [k, 0, 1], 0.4) for k in range(6)] + [("b", k, [k, 0, 1], 0.4 + k / 20) for k in range(12)] + [("c", k, [9 * k, 9 * k + 1, 9 * k + 2], 0.5 - k / 100) for k in range(12)]
    paths = spark.createDataFrame(rows, "query string, round int, nodes array<int>, salience double")
    assert [r["query"] for r in expansion.settled_queries(paths).collect()] == ["c"]  # a has too few, b still gains


def test_layout_of_a_forest(spark):
    g = Graph(spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4), (5, 6)], "src long, dst long"), spark.range(8), True)
    got = {r.id: (r.depth, r.leaves, r.x) for r in layout.forest_layout(g).collect()}
    assert got == {0: (0, 3, 1.0), 1: (1, 2, 0.5), 2: (1, 1, 2.0), 3: (2, 1, 0.0), 4: (2, 1, 1.0), 5: (0, 1, 3.0), 6: (1, 1, 3.0), 7: (0, 1, 4.0)}
    with pytest.raises(ValueError, match="one parent"):
        layout.forest_layout(Graph(spark.createDataFrame([(0, 2), (1, 2)], "src long, dst long"), None, True))
