"""Graph operators against plain Python on small graphs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators import blocks, communities, expansion, motifs, paths, traversal, truth
from meshwork.plans import analyze, classes, generate, generator_queries, graph_queries
from meshwork.sources import formats
from meshwork.streaming.edges import degree_stream

RNG = random.Random(9)
EDGES = sorted({tuple(sorted(RNG.sample(range(14), 2))) for _ in range(24)} | {(20, 21), (21, 22)})


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.createDataFrame(EDGES, "src long, dst long"), spark.range(23))


def around() -> dict[int, set[int]]:
    out = defaultdict(set)
    for a, b in EDGES:
        out[a].add(b)
        out[b].add(a)
    return out


def test_levels_components_cores(graph, spark):
    n = around()
    dist, front = {0: 0}, [0]
    while front:
        front = [v for u in front for v in n[u] if v not in dist and not dist.update({v: dist[u] + 1})]
    assert {r.id: r.hops for r in traversal.levels(graph, spark.createDataFrame([(0,)], "id long")).collect()} == dist
    label = {r.id: r.component for r in traversal.components(graph).collect()}
    assert all(label[a] == label[b] for a, b in EDGES) and label[15] == 15 and label[22] == 20
    core = {r.id: r.core for r in traversal.core_numbers(graph).collect()}
    left = {u: set(v) for u, v in n.items()}
    want, k = {}, 0
    while left:
        u = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[u]))
        want[u] = k
        for v in left.pop(u):
            left[v].discard(u)
    assert core == want


def test_motifs(graph):
    n = around()
    tri = {t for t in itertools.combinations(sorted(n), 3) if all(b in n[a] for a, b in itertools.combinations(t, 2))}
    assert {(r.a, r.b, r.c) for r in motifs.triangles(graph).collect()} == tri
    p4 = sum(1 for a, b, c, d in itertools.permutations(sorted(n), 4) if b in n[a] and c in n[b] and d in n[c] and c not in n[a] and d not in n[b] and d not in n[a]) // 2
    assert motifs.induced_paths4(graph).first().n == p4
    left = set(EDGES)
    while True:
        m = defaultdict(set)
        for a, b in left:
            m[a].add(b)
            m[b].add(a)
        keep = {(a, b) for a, b in left if len(m[a] & m[b]) >= 1}
        if keep == left:
            break
        left = keep
    assert {(r.src, r.dst) for r in motifs.k_truss(graph, 3).collect()} == left


def test_directed_orders(spark):
    arcs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (7, 8), (6, 8)]
    g = Graph(spark.createDataFrame(arcs, "src long, dst long"), None, True)
    assert {r.id: r.component for r in traversal.strong_components(g).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    level = {r.id: r.level for r in traversal.topological_levels(g).collect()}
    assert level[6] == 0 and level[7] == 1 and level[8] == 2 and level[1] is None and level[4] is None


def test_paths_and_distances(graph, spark):
    n = around()
    pair = spark.createDataFrame([(0, 9)], "src long, dst long")
    want = set()

    def walk(nodes):
        if nodes[-1] == 9:
            want.add(tuple(nodes))
        elif len(nodes) <= 4:
            for v in n[nodes[-1]] - set(nodes):
                walk([*nodes, v])

    walk([0])
    assert {tuple(r.nodes) for r in paths.simple_paths(graph, pair, 4).collect()} == {p for p in want if len(p) <= 5}
    weighed = Graph(graph.edges.withColumn("w", (F.col("src") + F.col("dst")) % 5 + 1.0))
    best = {0: 0.0}
    for _ in range(30):
        for a, b in EDGES:
            w = (a + b) % 5 + 1.0
            for x, y in ((a, b), (b, a)):
                if x in best:
                    best[y] = min(best.get(y, 1e9), best[x] + w)
    assert {r.id: r.distance for r in traversal.distances(weighed, spark.createDataFrame([(0,)], "id long"), "w").collect()} == best


def test_communities_separate_cliques(spark):
    cliques = [(a + k, b + k) for k in (0, 10, 20) for a, b in itertools.combinations(range(6), 2)] + [(5, 10), (15, 20)]
    g = Graph(spark.createDataFrame(cliques, "src long, dst long"))
    found = {r.id: r.community for r in communities.leiden(g).collect()}
    assert [len({found[k + i] for i in range(6)}) for k in (0, 10, 20)] == [1, 1, 1] and len(set(found.values())) == 3
    member = spark.createDataFrame(list(found.items()), "id long, community long")
    assert communities.modularity(g, member).first().modularity == pytest.approx(45 / 47 - (31**2 + 32**2 + 31**2) / (4 * 47**2))


def test_generated_structure(spark):
    row = analyze.structure(generate.balanced_tree(spark, 2, 15)).first()
    assert row.tree and row.bipartite and row.triangles == 0
    assert analyze.properties(generate.cycle(spark, 7)).first().regular
    assert analyze.structure(generate.complete(spark, 6)).first().triangles == 20
    assert not analyze.structure(generate.cycle(spark, 5)).first().bipartite
    assert generate.preferential(spark, 50, 2).edges.count() > 49


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n1\t2\n\n2 3 0.5\nx\n")
    assert {(r.src, r.dst, r.weight) for r in formats.edge_list(spark, str(tmp_path / "a.txt")).collect()} == {("1", "2", None), ("2", "3", 0.5)}
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 3 2\n1 2 0.5\n3 1 2\n")
    assert {tuple(r) for r in formats.matrix_market(spark, str(tmp_path / "a.mtx")).collect()} == {(1, 2, 0.5), (3, 1, 2.0)}
    (tmp_path / "a.net").write_text('*Vertices 2\n1 "A b"\n2 "C"\n*Arcs\n1 2 3\n*Edges\n2 1\n')
    vertices, edges = formats.pajek(spark, str(tmp_path / "a.net"))
    assert {tuple(r) for r in vertices.collect()} == {("1", "A b"), ("2", "C")}
    assert {tuple(r) for r in edges.collect()} == {("1", "2", 3.0, True), ("2", "1", 1.0, False)}
    (tmp_path / "a.dl").write_text("dl n=2 format=fullmatrix\ndata:\n0 1\n2 0\n")
    assert {tuple(r) for r in formats.ucinet(spark, str(tmp_path / "a.dl")).collect()} == {("1", "2", 1.0), ("2", "1", 2.0)}
    v = spark.createDataFrame([(1, "A b"), (2, "C")], "id long, label string")
    e = spark.createDataFrame([(1, 2, 1.5), (2, 1, None)], "src long, dst long, weight double")
    formats.write_gml(v, e, str(tmp_path / "g"))
    back, links = formats.gml(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in back.collect()} == {("1", "A b"), ("2", "C")}
    assert {tuple(r) for r in links.collect()} == {("1", "2", 1.5), ("2", "1", None)}


def test_stream_of_edges(spark, tmp_path, graph):
    graph.edges.write.parquet(str(tmp_path / "edges"))
    stream = degree_stream(spark.readStream.schema(graph.edges.schema).parquet(str(tmp_path / "edges")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r.id: r.degree for r in spark.table("degrees").collect()} == {k: len(v) for k, v in around().items()}


def plain_expansion(edges, seeds, band):
    """Each query's frontier vertices of the lowest band expand together, until nothing is left."""
    n = defaultdict(set)
    for a, b in edges:
        n[a].add(b)
        n[b].add(a)
    owned = {}
    for q, s in seeds:
        owned[q, s, s] = (None, 0, 0)
    done, r = set(), 0
    while left := set(owned) - done:
        r += 1
        low = {q: min(band(len(n[v]), owned[q, s, v][1]) for x, s, v in left if x == q) for q, _, _ in left}
        now = {(q, s, v) for q, s, v in left if band(len(n[v]), owned[q, s, v][1]) == low[q]}
        fresh = defaultdict(list)
        for q, s, v in now:
            for w in n[v]:
                if (q, s, w) not in owned:
                    fresh[q, s, w].append((owned[q, s, v][1] + 1, v))
        for k, found in fresh.items():
            depth, parent = min(found)
            owned[k] = (parent, depth, r)
        done |= now
    return {(*k, *v) for k, v in owned.items()}


STAR = [(0, k) for k in range(1, 8)] + [(1, 20), (20, 21), (21, 7), (30, 31)]


@pytest.mark.parametrize("order", ["degree", "breadth_first"])
def test_expansion_runs_to_exhaustion(spark, order):
    g = Graph(spark.createDataFrame(STAR, "src long, dst long"))
    seeds = [(0, 1), (0, 21), (1, 30)]
    owned = expansion.expand(g, spark.createDataFrame(seeds, "query long, seed long"), order)
    rule = (lambda d, depth: (d + 1).bit_length() - 1) if order == "degree" else (lambda d, depth: depth)
    assert {tuple(r) for r in owned.collect()} == plain_expansion(STAR, seeds, rule)
    assert {r.id for r in expansion.meetings(owned).collect()} == {0, 1, 2, 3, 4, 5, 6, 7, 20, 21}


def test_expansion_stops_and_what_is_read_of_it(spark):
    g = Graph(spark.createDataFrame(STAR, "src long, dst long"))
    seeds = spark.createDataFrame([(0, 2), (0, 20)], "query long, seed long")
    owned = expansion.expand(g, seeds, "breadth_first", stop="common").cache()
    assert max(r["round"] for r in owned.collect()) == 2  # 2-0-1-20: they meet after two steps each
    ways = expansion.meeting_paths(owned).collect()
    assert [2, 0, 1, 20] in [r.nodes for r in ways] and all(len(set(r.nodes)) == len(r.nodes) for r in ways)
    assert [(r.a, r.b) for r in expansion.overlaps(owned).collect()] == [(2, 20)] == [(r.a, r.b) for r in expansion.sphere_overlaps(owned).collect()]
    assert expansion.stopped(owned, seeds, "pairwise", 12).count() == expansion.stopped(owned, seeds, "connected", 12).count() == 1


def test_string_ids(spark):
    named = Graph(spark.createDataFrame([(f"v{a:02}", f"v{b:02}") for a, b in EDGES], "src string, dst string"))
    label = {r.id: r.component for r in traversal.components(named).collect()}
    assert label["v22"] == "v20" and all(label[f"v{a:02}"] == label[f"v{b:02}"] for a, b in EDGES)
    assert {r.label for r in traversal.label_propagation(named, 2).collect()} <= set(label)


def test_blocks(graph):
    n = around()

    def parts(gone=None):
        left, count = {v for v in n if v != gone}, 0
        while left:
            front = [left.pop()]
            count += 1
            while front:
                for v in n[front.pop()] & left:
                    left.discard(v)
                    front.append(v)
        return count

    found = blocks.biconnected(graph).cache()
    assert {(r.src, r.dst) for r in found.collect()} == set(EDGES)
    cut = {v for v in n if parts(v) > parts()}
    assert {r.id for r in blocks.articulation_points(found).collect()} == cut
    rest = lambda e: Counter(x for p in EDGES if p != e for x in p)

    def splits(e):
        seen, front = {e[0]}, [e[0]]
        while front:
            u = front.pop()
            for v in n[u]:
                if {u, v} != set(e) and v not in seen:
                    seen.add(v)
                    front.append(v)
        return e[1] not in seen

    assert rest(EDGES[0]) and {(r.src, r.dst) for r in blocks.bridges(found).collect()} == {e for e in EDGES if splits(e)}


def test_walks_and_planted_paths(spark, graph):
    n = around()
    pair = spark.createDataFrame([(0, 9)], "src long, dst long")
    for r in truth.sampled_paths(graph, pair, 6, 14).collect():
        assert r.nodes[0] == 0 and r.nodes[-1] == 9 and len(set(r.nodes)) == len(r.nodes) and all(b in n[a] for a, b in itertools.pairwise(r.nodes))
    wide, made = truth.planted(graph, pair, 2, 3, 0.5, 0.9)
    assert sorted(r.nodes for r in made.collect()) == [[0, 23 + 2 * k, 24 + 2 * k, 9] for k in range(3)]
    assert wide.edges.count() == len(EDGES) + 9
    from collections import deque

    dist, queue = {0: 0}, deque([0])
    while queue:
        u = queue.popleft()
        for v in n[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    if 9 in dist:
        short = paths.shortest_paths(graph, pair).collect()
        assert {r.hops for r in short} == {dist[9]} and all(b in n[a] for r in short for a, b in itertools.pairwise(r.nodes))


def test_modularity_grows_and_divisions_are_connected(spark, graph):
    found = communities.leiden(graph).cache()
    alone = graph.ids().select("id", F.col("id").alias("community"))
    q = communities.modularity(graph, found).first().modularity
    assert q > communities.modularity(graph, alone).first().modularity and q > 0.2
    assert communities.split_disconnected(graph, found).select("community").distinct().count() == found.select("community").distinct().count()


def test_betweenness_of_a_path(spark):
    g = generate.path(spark, 5)
    got = {r.id: r.betweenness for r in expansion.betweenness(g, spark.range(5)).collect()}
    assert got == {0: 0.0, 1: 6.0, 2: 8.0, 3: 6.0, 4: 0.0}


def test_betweenness_query_has_all_sources(spark, graph, monkeypatch):
    n = around()
    monkeypatch.setattr(graph_queries, "_strong", lambda spark, sf: graph)

    def shortest(s, t):
        front = [[s]]
        while front:
            if done := [p for p in front if p[-1] == t]:
                return done
            front = [[*p, v] for p in front for v in n[p[-1]] - set(p)] if len(front[0]) <= len(n) else []
        return []

    want = dict.fromkeys(range(23), 0.0)
    for s, t in itertools.permutations(sorted(n), 2):
        found = shortest(s, t)
        for p in found:
            for u in p[1:-1]:
                want[u] += 1 / len(found)
    got = {r.id: r.betweenness for r in graph_queries.betweenness(spark, "").collect()}
    assert {k: v for k, v in want.items() if v} == pytest.approx({k: v for k, v in got.items() if v})


def test_nearest_class_and_its_report(spark):
    known = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 10.0, 1.0), ("b", 12.0, 1.0)], "label string, x double, y double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 11.0, 1.0), (3, 5.0, 1.0)], "item long, x double, y double")
    got = {r.item: (r.predicted, round(r.confidence, 6)) for r in classes.nearest_class(points, known, ["x", "y"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 1.0), 3: ("a", 0.6)}
    told = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "predicted string, actual string")
    assert {(r.label, r.precision, r.recall, r.support) for r in classes.classifier_report(told).collect()} == {("a", 0.5, 1.0, 1), ("b", 1.0, 0.5, 2)}


@pytest.mark.parametrize("name", sorted(generator_queries.KNOWN))
def test_what_is_known_of_made_graphs_is_inferred(spark, name):
    make, known = generator_queries.KNOWN[name]
    rows = analyze.validate(make(spark), known).collect()
    assert {r.property for r in rows} == set(known) and all(r.valid and not r.message for r in rows), rows


def test_faults_of_a_flow_network(spark):
    assert {tuple(r) for r in generator_queries.flow_validation(spark, "").collect()} == {("edge out of the sink", 1), ("vertex on no way", 2)}
