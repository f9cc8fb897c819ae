"""Work that must not grow faster than the tables: results at sizes that listing all pairs or copies would not reach."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from meshwork import graph as model
from meshwork.functions import statistics
from meshwork.graph import Graph
from meshwork.operators import certificates, communities, expansion, flow, motifs, spectral, sweeps, tiles, traversal
from meshwork.plans import analyze, classes


def test_resamples_make_no_rows(spark):
    rows = [(k, "ab"[k % 2], None if k == 7 else float(k * k % 101)) for k in range(200)]
    samples = spark.createDataFrame(rows, "id long, method string, value double")
    drawn = samples.select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("r")).withColumn("w", statistics.poisson_weight(statistics.draw(42, F.col("id"), F.col("r"))))
    want = {(x.method, x.r): (x.w, x.wv) for x in drawn.groupBy("method", "r").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("wv")).collect()}
    found = statistics.resampled(samples, 30, 42)
    assert {(x.method, x.r): (x.w, x.wv) for x in found.collect()} == want
    for df in (statistics.bootstrap(samples, 30), statistics.bootstrap_difference(samples, "a", "b", 30)):
        assert "Generate" not in df._jdf.queryExecution().toString()


def plain_kendall(rows):
    sign = lambda x: (x > 0) - (x < 0)
    s = n = ta = tb = pairs = 0
    for (i, a, b), (j, c, d) in itertools.product(rows, rows):
        if i < j:
            da, db = sign(a - c), sign(b - d)
            s, n, ta, tb, pairs = s + da * db, n + abs(da * db), ta + (da == 0 and db != 0), tb + (db == 0 and da != 0), pairs + 1
    low = math.sqrt((n + ta) * (n + tb))
    return (s / pairs if pairs else 1.0, s / low if low else 0.0)


def test_rank_agreement_pairs_kinds(spark):
    rng = random.Random(5)
    few = {r: [(rng.randrange(25), rng.randrange(4), rng.randrange(3)) for _ in range(n)] for r, n in (("x", 40), ("y", 1), ("z", 12))}
    few["same"] = [(1, 2, 3), (1, 3, 4)]
    rows = [(r, *x) for r, xs in few.items() for x in xs]
    many = spark.range(100_000).select(F.lit("many").alias("ranking"), F.col("id").alias("item"), (F.col("id") % 2).alias("a"), (F.col("id") % 2).alias("b"))
    found = {x.ranking: (x.tau_a, x.tau_b) for x in statistics.kendall(spark.createDataFrame(rows, "ranking string, item long, a long, b long").union(many)).collect()}
    assert math.isclose(found.pop("many")[0], 50_000**2 / math.comb(100_000, 2))
    for r, xs in few.items():
        assert all(math.isclose(p, q, abs_tol=1e-12) for p, q in zip(found[r], plain_kendall(xs), strict=True))


def test_patterns_are_counted_without_listing_copies(spark):
    star = Graph(spark.range(1, 1501).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    assert {r.pattern: r.copies for r in classes.pattern_counts(star, ["P3", "claw", "diamond", "P4"]).collect()} == {"P3": math.comb(1500, 2), "claw": math.comb(1500, 3), "diamond": 0, "P4": 0}
    assert classes.is_free_of(star, ["P4", "K3"]) and not classes.is_free_of(star, ["claw"])
    rng = random.Random(8)
    edges = [(a, b) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.45]
    g = Graph(spark.createDataFrame(edges, "src long, dst long"))
    listed = {n: classes.induced_copies(g, n).count() // classes.automorphisms(classes.pattern(n)) for n in classes.COUNTED}
    assert motifs.induced_counts(g) == listed


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(model, "PART_ROWS", 50)
    rows = [(k, (k * 7 + j * j) % 40) for k in range(60) for j in range(5)]
    df = spark.createDataFrame(rows, "o long, s long")
    want: dict[tuple, int] = {}
    for k in range(60):
        for a, b in itertools.combinations(sorted({s for o, s in rows if o == k}), 2):
            want[a, b] = want.get((a, b), 0) + 1
    found = model.meeting_items(df, "o", "s", repeats=False)
    assert {(r.a, r.b): r.n for r in found.collect()} == want
    assert found.rdd.getNumPartitions() == 12  # ten pairs an order


def test_distances_hold_no_row_for_a_pair(spark, monkeypatch):
    written = []
    keep = model.checkpointed
    rng = random.Random(4)
    edges = [(a, (a + 1) % 150) for a in range(150)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(25)] + [(900, 901), (901, 902)]
    near: dict[int, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops = {}
    for s in near:
        dist, front = {s: 0}, [s]
        while front:
            front = [v for u in front for v in near[u] if v not in dist and not dist.update({v: dist[u] + 1})]
        hops[s] = dist
    pairs = [h for s, d in hops.items() for v, h in d.items() if v != s]
    far = [max(d.values()) for d in hops.values()]

    def spied(df):
        out = keep(df)
        written.append(out.count())
        return out

    for module in (model, classes, traversal):
        monkeypatch.setattr(module, "checkpointed", spied)
    row = classes.distances_row(Graph(spark.createDataFrame(edges, "src long, dst long"))).first()
    assert (row.diameter, row.radius) == (max(far), min(far)) and math.isclose(row.mean_distance, sum(pairs) / len(pairs))
    assert max(written) < len(pairs) / 10
    lone = Graph(spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert tuple(classes.distances_row(lone).first()) == (0, 0, None)
    arc = Graph(spark.createDataFrame([(1, 2)], "src long, dst long"), None, True)
    assert tuple(classes.distances_row(arc).first()) == (1, 0, 1.0)


def test_validation_counts_small_patterns_once(spark, monkeypatch):
    calls = []
    count = motifs.induced_counts
    monkeypatch.setattr(motifs, "induced_counts", lambda g: calls.append(1) or count(g))
    monkeypatch.setattr(classes, "induced_copies", None)  # no copy is listed
    star = Graph(spark.range(1, 6).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    assert analyze.inferred(star, ["cograph", "claw_free"]) == {"cograph": True, "claw_free": False}
    assert len(calls) == 1


def plain_betweenness(arcs, n):
    out = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        hops, ways, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in sorted(v for x, v in arcs if x == u):
                if v not in hops:
                    hops[v], ways[v] = hops[u] + 1, 0
                    order.append(v)
                ways[v] += ways[u] if hops[v] == hops[u] + 1 else 0
        delta = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            delta[u] = sum(ways[u] / ways[v] * (1 + delta[v]) for x, v in arcs if x == u and hops[v] == hops[u] + 1)
            out[u] += delta[u] if u != s else 0
    return out


def test_betweenness_makes_no_row_of_a_pair(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tiles, "checkpointed", lambda df: written.append(model.checkpointed(df)) or written[-1])
    monkeypatch.setattr(tiles, "measured", lambda df, *a: (lambda r: written.append(r[0]) or r)(model.measured(df, *a)))
    monkeypatch.setattr(tiles, "dropped", lambda *frames: None)
    star = Graph(spark.range(1, 1501).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), spark.range(1502))
    found = {r.id: r.betweenness for r in expansion.betweenness(star, star.ids()).collect()}
    assert found == {v: 1500.0 * 1499 if v == 0 else 0.0 for v in range(1502)}
    assert max(df.count() for df in written) <= 1502
    rng = random.Random(3)
    arcs = {(a, b) for a in range(20) for b in range(20) if a != b and rng.random() < 0.12}
    g = Graph(spark.createDataFrame(sorted(arcs), "src long, dst long"), spark.range(20), True)
    got = {r.id: r.betweenness for r in expansion.betweenness(g, g.ids()).collect()}
    want = plain_betweenness(arcs, 20)
    assert all(math.isclose(got[v], want[v], abs_tol=1e-9) for v in want) and len(got) == 20


def test_no_level_becomes_a_table(spark, monkeypatch):
    written = []
    for module in (tiles, classes, sweeps):
        monkeypatch.setattr(module, "checkpointed", lambda df: written.append(1) or model.checkpointed(df), raising=False)
        monkeypatch.setattr(module, "measured", lambda df, *a: written.append(1) or model.measured(df, *a))
    path = Graph(spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert tuple(classes.distances_row(path).first())[:2] == (40, 20)
    assert {r.id: r.betweenness for r in expansion.betweenness(path, path.ids()).collect()} == {k: 2.0 * k * (40 - k) for k in range(41)}
    assert len(written) < 10  # one a level would be 80 and more


def test_sweeps_equal_tiles_and_rows_of_bits(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(sweeps, "PULLED", 5)
    monkeypatch.setattr(sweeps, "CELLS", 300)
    for directed, density in ((False, 0.3), (True, 0.06)):
        arcs = [(a, b) for a in range(24) for b in range(24) if a != b and rng.random() < density]
        g = Graph(spark.createDataFrame(arcs, "src long, dst long"), spark.range(26), directed)
        sources, found = spark.range(0, 26, 3), {}
        for held in (1 << 23, -1):
            monkeypatch.setattr(sweeps, "HELD_ARCS", held)
            found[held] = {r.id: r.betweenness for r in expansion.betweenness(g, sources).collect()}, tuple(classes.distances_row(g).first())
        (swept, far), (tiled, also) = found.values()
        assert all(math.isclose(swept[v], tiled[v], abs_tol=1e-9) for v in range(26)) and len(swept) == 26
        assert far[:2] == also[:2] and math.isclose(far[2], also[2])


def test_rounds_broadcast_few_rows(spark, monkeypatch):
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    monkeypatch.setattr(model, "LOOP_ROWS", 5)
    ring = Graph(spark.range(12).select(F.col("id").alias("src"), ((F.col("id") + 1) % 12).alias("dst")))
    seeds = spark.createDataFrame([(1, 0), (1, 6)], "query int, seed long")
    for order in ("adaptive", "retrospective"):
        assert expansion.expand(ring, seeds, order).count() == 24
    assert max(sent) <= 5


def test_pairs_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(certificates, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or model.checkpointed(df))
    ring = Graph(spark.range(7).select(F.col("id").alias("src"), ((F.col("id") + 1) % 7).alias("dst")))
    assert certificates.asteroidal_triples(ring).count() == 7
    assert any("strategy=merge" in p for p in plans)


def test_forced_arcs_are_tied_to_a_pivot(spark, monkeypatch):
    ties = []
    monkeypatch.setattr(certificates, "min_labels", lambda e: ties.append(e.count()) or traversal.min_labels(e))
    star = Graph(spark.range(1, 601).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    assert {tuple(r["class"]) for r in certificates.forced_arcs(star).collect()} == {(0, 1), (1, 0)}
    assert ties.pop() <= 4 * 600
    rng = random.Random(4)
    edges = [e for e in itertools.combinations(range(16), 2) if rng.random() < 0.6]
    near = {(a, b) for e in edges for a, b in itertools.permutations(e)}
    label = {a: a for a in near}
    while True:
        forced = [(x, y) for x in near for y in near if (x[0] == y[0] and (x[1], y[1]) not in near) or (x[1] == y[1] and (x[0], y[0]) not in near)]
        low = {x: min([label[x], *(label[y] for z, y in forced if z == x)]) for x in near}
        if low == label:
            break
        label = low
    got = certificates.forced_arcs(Graph(spark.createDataFrame(edges, "src long, dst long")))
    assert {(r.src, r.dst): tuple(r["class"]) for r in got.collect()} == label


def test_a_topological_level_is_one_job(spark, monkeypatch):
    written = []
    monkeypatch.setattr(model, "scratch", lambda spark, name, real=model.scratch: written.append(name) or real(spark, name))
    arcs = [(k, k + 1) for k in range(12)] + [(0, 5), (20, 21), (21, 22), (22, 21), (22, 12), (30, 30)]
    got = {r.id: r.level for r in traversal.topological_levels(Graph(spark.createDataFrame(arcs, "src long, dst long"), None, True)).collect()}
    assert got == {**{k: k for k in range(12)}, 12: None, 20: 0, 21: None, 22: None, 30: None}
    assert len(written) <= 12 + 3


def test_rounds_over_many_vertices_broadcast_nothing(spark, monkeypatch):
    edges = [(a + 10 * k, b + 10 * k) for k in range(4) for a, b in itertools.combinations(range(6), 2)]
    g = Graph(spark.createDataFrame(edges, "src long, dst long"))
    plans, write = [], model.checkpointed

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(model, "checkpointed", told)
    rounds = lambda: [("BroadcastExchange" in p) for p in plans if "own_tot" in p]
    few = {r.id: r.community for r in communities.leiden(g, levels=1).collect()}
    assert any(rounds())
    monkeypatch.setattr(model, "LOOP_ROWS", 0)
    plans.clear()
    assert {r.id: r.community for r in communities.leiden(g, levels=1).collect()} == few
    assert rounds() and not any(rounds())
    x = spark.createDataFrame([(k, 1.0) for k in range(6)], "id long, x0 double")
    entries = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))
    assert "BroadcastExchange" not in spectral._times(x, entries, 1, 6)._jdf.queryExecution().executedPlan().toString()


def test_a_round_of_infomap_deals_links_once(spark):
    g = Graph(spark.createDataFrame([(a, (a + d) % 30) for a in range(30) for d in (1, 2)], "src long, dst long"))
    visits, steps = flow.flows(g)
    state = model.checkpointed(visits.select("id", F.col("id").alias("module"), "p"))
    sums = model.checkpointed(flow.module_sums(state, steps, 30))
    links = model.checkpointed(flow.both_ways(steps))
    for disjoint in (False, True):
        plan = flow._proposed(state, links, sums, 1.0, 30, 0, disjoint)._jdf.queryExecution().executedPlan().toString()
        whole = [x for x in plan.split("\n") if "FileScan" in x and "[u#" in x]
        assert len(whole) == 1 and sum("BroadcastExchange" in x for x in plan.split("\n")) <= 5
