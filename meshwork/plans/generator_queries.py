"""Queries that make graphs of each family, with the SQL that makes the same edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.plans import analyze, generate
from meshwork.plans.generate import draws_for

QUERIES: dict = {}
SQL: dict[str, str] = {}


def D(seed: int, *columns: str) -> str:
    """The SQL of `draw`."""
    return f"(('0x' || left(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def I(u: str, n: str | int) -> str:  # noqa: E743
    return f"floor({u} * {n})::BIGINT"


def _plain(rows: str) -> str:
    return f"SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({rows}) WHERE src <> dst"


def _r(a: object, b: object | None = None) -> str:
    return f"range(0, {a}) t(id)" if b is None else f"range({a}, {b}) t(id)"


def _all_pairs(n: int, where: str) -> str:
    return f"SELECT src, dst FROM range(0, {n}) a(src), range(0, {n}) b(dst) WHERE src < dst AND {where}"


def _drawn(n: int, k: int, seed: int = 42) -> str:
    return f"SELECT {I(D(seed, 'id'), n)} AS src, {I(D(seed + 1, 'id'), n)} AS dst FROM {_r(k)}"


def add(name: str, make, sql: str | None, columns: tuple[str, ...] = ("src", "dst")) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return make(spark).edges.select(*columns)

    run.__name__ = f"generated_{name}"
    QUERIES[run.__name__] = run
    if sql:
        SQL[run.__name__] = sql


_path = lambda n: f"SELECT id AS src, id + 1 AS dst FROM {_r(n - 1)}"
_grid = lambda r, c: f"SELECT id AS src, id + 1 AS dst FROM {_r(r * c)} WHERE id % {c} < {c - 1} UNION ALL SELECT id, id + {c} FROM {_r((r - 1) * c)}"
_tree = lambda n, seed=42: f"SELECT {I(D(seed, 'id'), 'id')} AS src, id AS dst FROM {_r(1, n)}"
_forest = lambda n, k: f"SELECT id % {k} + {k} * {I(D(42, 'id'), f'(id // {k})')} AS src, id AS dst FROM {_r(k, n)}"
_zigzag = lambda a, b: _plain(f"SELECT id AS src, {a} + least(id, {b - 1}) AS dst FROM {_r(a)} UNION ALL SELECT least(id + 1, {a - 1}), {a} + id FROM {_r(b)}")
_steps = lambda n, steps: _plain(f"SELECT id AS src, (id + s) % {n} AS dst FROM {_r(n)}, (SELECT unnest({list(steps)}) AS s)")

add("path", lambda s: generate.path(s, 60), _path(60))
add("cycle", lambda s: generate.cycle(s, 60), f"SELECT id AS src, (id + 1) % 60 AS dst FROM {_r(60)}")
add("star", lambda s: generate.star(s, 60), f"SELECT 0::BIGINT AS src, id AS dst FROM {_r(1, 60)}")
add("wheel", lambda s: generate.wheel(s, 40), _plain(f"SELECT 0 AS src, id AS dst FROM {_r(1, 40)} UNION ALL SELECT id, id % 39 + 1 FROM {_r(1, 40)}"))
add("grid", lambda s: generate.grid(s, 12, 9), _grid(12, 9))
add("torus", lambda s: generate.torus(s, 8, 7), _plain(f"SELECT id AS src, (id // 7) * 7 + (id + 1) % 7 AS dst FROM {_r(56)} UNION ALL SELECT id, (id + 7) % 56 FROM {_r(56)}"))
add("planar", lambda s: generate.triangulated_grid(s, 8, 7), f"{_grid(8, 7)} UNION ALL SELECT id, id + 8 FROM {_r(49)} WHERE id % 7 < 6")
add("complete", lambda s: generate.complete(s, 40), _all_pairs(40, "true"))
add("complete_bipartite", lambda s: generate.complete_bipartite(s, 7, 9), f"SELECT src, dst FROM range(0, 7) a(src), range(7, 16) b(dst)")
add("hypercube", lambda s: generate.hypercube(s, 6), "SELECT i AS src, i + (1 << k) AS dst FROM range(0, 64) a(i), range(0, 6) b(k) WHERE i & (1 << k) = 0")
add("tree", lambda s: generate.balanced_tree(s, 3, 121), "SELECT (i - 1) // 3 AS src, i AS dst FROM range(1, 121) t(i)")
add("circulant", lambda s: generate.circulant(s, 50, [1, 5, 7]), _steps(50, [1, 5, 7]))
add("random_tree", lambda s: generate.random_tree(s, 500), _tree(500))
add("forest", lambda s: generate.forest(s, 500, 7), _forest(500, 7))
add("disconnected", lambda s: generate.disconnected(s, 500, 7), _plain(f"{_forest(500, 7)} UNION ALL SELECT id - 14, id FROM {_r(14, 500)}"))
add("connected", lambda s: generate.connected_cyclic(s, 500, 300), _plain(f"{_tree(500)} UNION ALL {_drawn(500, 300, 43)}"))
add("bipartite_tree", lambda s: generate.bipartite_tree(s, 20, 12), _zigzag(20, 12))
add("bipartite_forest", lambda s: generate.bipartite_forest(s, 20, 12), f"SELECT * FROM ({_zigzag(20, 12)}) WHERE src % 4 > 0")
add("bipartite", lambda s: generate.bipartite_connected(s, 40, 30, 200), _plain(f"{_zigzag(40, 30)} UNION ALL SELECT {I(D(42, 'id'), 40)}, 40 + {I(D(43, 'id'), 30)} FROM {_r(200)}"))
add("bipartite_disconnected", lambda s: generate.bipartite_disconnected(s, 9), f"SELECT id AS src, id - id % 4 + k AS dst FROM {_r(36)}, (SELECT unnest([2, 3]) AS k) WHERE id % 4 < 2")
add("tournament", lambda s: generate.tournament(s, 40), f"SELECT CASE WHEN down THEN src ELSE dst END AS src, CASE WHEN down THEN dst ELSE src END AS dst FROM (SELECT *, {D(42, 'src', 'dst')} < 0.5 AS down FROM ({_all_pairs(40, 'true')}))")
add("dag", lambda s: generate.random_dag(s, 200, 900), _plain(_drawn(200, 900)))
add("random", lambda s: generate.random_graph(s, 300, 0.05), _plain(f"SELECT a AS src, b + (b >= a)::INT AS dst FROM (SELECT {I(D(42, 'id', '0'), 300)} AS a, {I(D(42, 'id', '1'), 299)} AS b FROM {_r(draws_for(300, 0.05))})"))
add("preferential", lambda s: generate.preferential(s, 2000, 3), "WITH " + f"""r AS (SELECT id, list_reduce(list_prepend({I(D(42, '2 * id + 1'), '(2 * id + 1)')}, range(0, {generate.FOLLOWED})), lambda r, k: CASE WHEN r % 2 = 1 THEN {I(D(42, 'r'), 'r')} ELSE r END) AS r FROM {_r(3 * 1999)}),
e AS (SELECT id // 3 + 1 AS src, (r // 2) // 3 AS t FROM r) """ + _plain("SELECT src, CASE WHEN t + 1 >= src THEN 0 ELSE t + 1 END AS dst FROM e"))
add("small_world", lambda s: generate.small_world(s, 400, 3, 0.1), _plain(f"SELECT id AS src, CASE WHEN {D(42, 'id', 's')} < 0.1::DOUBLE THEN {I(D(43, 'id', 's'), 400)} ELSE (id + s) % 400 END AS dst FROM {_r(400)}, range(1, 4) u(s)"))
add("modular", lambda s: generate.modular(s, 5, 40, 200, 90), _plain(f"SELECT id % 5 + 5 * {I(D(42, 'id'), 40)} AS src, id % 5 + 5 * {I(D(43, 'id'), 40)} AS dst FROM {_r(1000)} UNION ALL {_drawn(200, 90, 44)}"))
add("flow", lambda s: generate.flow_network(s, 5, 6), f"WITH e AS (SELECT id AS src, id - (id - 1) % 6 + 5 + k AS dst FROM {_r(1, 25)}, range(1, 7) u(k) UNION ALL SELECT 0, id FROM {_r(1, 7)} UNION ALL SELECT id, 31 FROM {_r(25, 31)}) SELECT src, dst, 1 + {I(D(42, 'src', 'dst'), 10)} AS capacity FROM e", ("src", "dst", "capacity"))
add("treewidth", lambda s: generate.k_path(s, 80, 3), f"SELECT src, dst FROM range(0, 80) a(src), range(0, 80) b(dst) WHERE src < dst AND dst - src <= 3")
add("k_colourable", lambda s: generate.k_colourable(s, 200, 3, 900), f"SELECT * FROM ({_plain(_drawn(200, 900))}) WHERE src % 3 <> dst % 3")
add("split", lambda s: generate.split(s, 60), _all_pairs(60, f"src < 20 AND (dst < 20 OR {D(42, 'src', 'dst')} < 0.3::DOUBLE)"))
add("cograph", lambda s: generate.cograph(s, 60), _all_pairs(60, "floor(log2(xor(src, dst)))::INT % 2 = 0"))
add("threshold", lambda s: generate.threshold(s, 60), _all_pairs(60, f"{D(42, 'dst')} < 0.5"))
add("interval", lambda s: generate.interval(s, 300, 0.02), f"WITH i AS (SELECT id, {D(42, 'id')} AS a, {D(42, 'id')} + 0.02::DOUBLE * {D(43, 'id')} AS b FROM {_r(300)}) SELECT x.id AS src, y.id AS dst FROM i x JOIN i y ON x.id < y.id AND x.a <= y.b AND y.a <= x.b")
add("circular_arc", lambda s: generate.circular_arcs(s, 300, 0.02), f"WITH i AS (SELECT id, {D(42, 'id')} AS a, {D(42, 'id')} + 0.02::DOUBLE * {D(43, 'id')} AS b FROM {_r(300)}) SELECT x.id AS src, y.id AS dst FROM i x JOIN i y ON x.id < y.id AND (x.a <= y.b AND y.a <= x.b OR x.b - 1 >= y.a OR y.b - 1 >= x.a)")
add("proper_circular_arc", lambda s: generate.circular_arcs(s, 300, 0.02, True), f"WITH i AS (SELECT id, {D(42, 'id')} AS a, {D(42, 'id')} + 0.02::DOUBLE AS b FROM {_r(300)}) SELECT x.id AS src, y.id AS dst FROM i x JOIN i y ON x.id < y.id AND (x.a <= y.b AND y.a <= x.b OR x.b - 1 >= y.a OR y.b - 1 >= x.a)")
add("probe_interval", lambda s: generate.without_probes(generate.interval(s, 300, 0.02)), f"WITH i AS (SELECT id, {D(42, 'id')} AS a, {D(42, 'id')} + 0.02::DOUBLE * {D(43, 'id')} AS b FROM {_r(300)}) SELECT x.id AS src, y.id AS dst FROM i x JOIN i y ON x.id < y.id AND x.a <= y.b AND y.a <= x.b WHERE x.id % 3 <> 0 OR y.id % 3 <> 0")
add("probe_chordal", lambda s: generate.without_probes(generate.k_path(s, 80, 3)), "SELECT src, dst FROM range(0, 80) a(src), range(0, 80) b(dst) WHERE src < dst AND dst - src <= 3 AND (src % 3 <> 0 OR dst % 3 <> 0)")
add("permutation", lambda s: generate.permutation(s, 60), _all_pairs(60, f"{D(42, 'src')} > {D(42, 'dst')}"))
add("comparability", lambda s: generate.divisors(s, 200), _all_pairs(200, "(dst + 1) % (src + 1) = 0"))
add("unit_disk", lambda s: generate.unit_disk(s, 400, 0.05), f"WITH p AS (SELECT id, {D(42, 'id')} AS x, {D(43, 'id')} AS y FROM {_r(400)}) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05::DOUBLE * 0.05::DOUBLE")
add("self_complementary", lambda s: generate.self_complementary(s, 4), _all_pairs(16, "(src // 4 = dst // 4 AND src // 4 IN (1, 2) OR dst // 4 - src // 4 = 1)"))
add("strongly_regular", lambda s: generate.paley(s, 29), _all_pairs(29, "(dst - src) IN (SELECT x * x % 29 FROM range(1, 29) q(x))"))
add("hamiltonian", lambda s: generate.with_chords(generate.cycle(s, 80), s, 80, 40), _plain(f"SELECT id AS src, (id + 1) % 80 AS dst FROM {_r(80)} UNION ALL {_drawn(80, 40)}"))
add("traceable", lambda s: generate.with_chords(generate.path(s, 80), s, 80, 40), _plain(f"{_path(80)} UNION ALL {_drawn(80, 40)}"))
_caterpillar = lambda n, k: f"{_path(n)} UNION ALL SELECT id, {n} + id * {k} + k FROM {_r(n)}, range(0, {k}) u(k)"
add("caterpillar", lambda s: generate.caterpillar(s, 12, 3), _caterpillar(12, 3))
add("girth", lambda s: generate.tadpole(s, 9, 5), f"SELECT id AS src, (id + 1) % 9 AS dst FROM {_r(9)} UNION ALL SELECT CASE WHEN id = 0 THEN 0 ELSE 8 + id END, 9 + id FROM {_r(5)}")
add("block_graph", lambda s: generate.clique_chain(s, 6, 4), _all_pairs(19, "dst <= src - src % 3 + 3"))
add("independence", lambda s: generate.disjoint_cliques(s, 7, 4), _all_pairs(28, "src // 4 = dst // 4"))
add("domination", lambda s: generate.star_chain(s, 8, 2), _caterpillar(8, 2))
add("weighted", lambda s: generate.generate(s, "path", n=50, weight=(2.0, 5.0)), f"SELECT src, dst, 2 + 3.0::DOUBLE * {D(42, 'src', 'dst')} AS weight FROM ({_path(50)})", ("src", "dst", "weight"))
add("line_graph", lambda s: generate.line_graph(generate.grid(s, 4, 5)), f"WITH e AS (SELECT src || '-' || dst AS e, src, dst FROM ({_grid(4, 5)})) SELECT a.e AS src, b.e AS dst FROM e a JOIN e b ON a.e < b.e AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst))")
_V = "WITH ea AS (SELECT src AS u, dst AS v FROM (SELECT id AS src, id + 1 AS dst FROM range(0, 4) t(id))), eb AS (SELECT id AS u, (id + 1) % 5 AS v FROM range(0, 5) t(id)), aa AS (SELECT u, v FROM ea UNION SELECT v, u FROM ea), bb AS (SELECT u, v FROM eb UNION SELECT v, u FROM eb), p AS (SELECT x.id AS a, y.id AS b, x.id || '|' || y.id AS n FROM range(0, 5) x(id), range(0, 5) y(id))"
_RULES = {
    "cartesian": "p.a = q.a AND EXISTS (SELECT 1 FROM bb WHERE u = p.b AND v = q.b) OR p.b = q.b AND EXISTS (SELECT 1 FROM aa WHERE u = p.a AND v = q.a)",
    "tensor": "EXISTS (SELECT 1 FROM aa WHERE u = p.a AND v = q.a) AND EXISTS (SELECT 1 FROM bb WHERE u = p.b AND v = q.b)",
    "lexicographic": "EXISTS (SELECT 1 FROM aa WHERE u = p.a AND v = q.a) OR p.a = q.a AND EXISTS (SELECT 1 FROM bb WHERE u = p.b AND v = q.b)",
}
_RULES["strong"] = f"({_RULES['cartesian']}) OR ({_RULES['tensor']})"
for _kind, _rule in _RULES.items():
    add(f"{_kind}_product", lambda s, kind=_kind: generate.product(generate.path(s, 5), generate.cycle(s, 5), kind), f"{_V} SELECT p.n AS src, q.n AS dst FROM p JOIN p q ON p.n < q.n AND ({_rule})")


#: What is known of a made graph, by name: (how it is made, what it must be). Read by tests only: registered validations are of the tables' graphs.
KNOWN = {
    "complete": (lambda s: generate.complete(s, 6), {"complete": True, "regular": True, "split": True, "planar_by_edges": False, "max_degree": 5}),
    "star": (lambda s: generate.star(s, 9), {"split": True, "max_degree": 8, "simple": True}),
    "complete_bipartite": (lambda s: generate.complete_bipartite(s, 3, 4), {"complete_bipartite": True, "split": False, "distance_hereditary": True}),
    "split": (lambda s: generate.split(s, 24), {"split": True, "chordal": True}),
    "paley": (lambda s: generate.paley(s, 13), {"strongly_regular": True, "k": 6, "lambda": 2, "mu": 3}),
    "tournament": (lambda s: generate.tournament(s, 12), {"tournament": True, "directed": True, "directionality": "antisymmetric"}),
    "hypercube": (lambda s: generate.hypercube(s, 3), {"cubic": True, "diameter": 3, "radius": 3}),
    "disjoint": (lambda s: generate.disjoint_cliques(s, 5, 3), {"components": 5, "connected": False, "triangles": 5, "mean_clustering": 1.0, "transitivity": 1.0}),
    "multigraph": (lambda s: Graph(s.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (1, 1, 1.0)], "src long, dst long, weight double")), {"simple": False, "weighting": "weighted", "vertices": 2, "loops": 1}),
}


def flow_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of a flow network of which one vertex gets nothing and another one's edge to the sink is turned round."""
    g = generate.flow_network(spark, 3, 3)
    broken = g.edges.where("NOT (src = 0 AND dst = 2)").select(F.when(F.col("src") == 7, 10).otherwise(F.col("src")).cast("long").alias("src"), F.when(F.col("src") == 7, 7).otherwise(F.col("dst")).cast("long").alias("dst"), "capacity")
    return analyze.flow_faults(Graph(broken, g.vertices, True), 0, 10)

