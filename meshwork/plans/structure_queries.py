"""Queries over the structure of graphs derived from the tables: modules, trees of clusters, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators import certificates, communities, flow, hierarchy, layout, spectral
from meshwork.plans import analyze, classes
from meshwork.plans.graph_queries import STRONG, TRADE, TRANSITIONS, _strong
from meshwork.sources import derived

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(None)
def infomap(spark: SparkSession, sf: str) -> DataFrame:
    return flow.infomap(_strong(spark, sf))


@query(f"""WITH {STRONG}, p AS (SELECT u, d / sum(d) OVER () AS p FROM deg), s AS (SELECT u AS id, s_nationkey AS module, p FROM p JOIN supplier ON u = s_suppkey),
f AS (SELECT a.u, a.v, 1.0::DOUBLE / (SELECT count(*) FROM adj) AS f FROM adj a),
q AS (SELECT x.module, sum(f) AS q FROM f JOIN s x ON x.id = f.u JOIN s y ON y.id = f.v WHERE x.module <> y.module GROUP BY 1),
m AS (SELECT module, sum(p) AS p, coalesce(max(q), 0) AS q FROM s LEFT JOIN q USING (module) GROUP BY module)
SELECT count(*) AS modules, round(sum(q) * log2(sum(q)) - 2 * sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) + sum((q + p) * log2(q + p)) - (SELECT sum(p * log2(p)) FROM p), 9) AS bits FROM m""")
def map_equation(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of a step when the suppliers' nations are the modules."""
    g = _strong(spark, sf)
    visits, steps = flow.flows(g)
    nations = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("module"))
    return flow.description_length(visits, steps, nations).select("modules", F.round("bits", 9).alias("bits"))


def _tree_sql(linkage: str, rounds: int) -> str:
    parts = [f"WITH {STRONG}, top AS (SELECT max(w) AS w FROM strong), s0 AS (SELECT src AS a, dst AS b, w::DOUBLE AS s FROM strong), z0 AS (SELECT u AS c, 1::BIGINT AS z FROM deg)"]
    near = "s / (x.z * y.z)" if linkage == "average" else "s / 1"
    new = "sum(s)" if linkage == "average" else "min(s)"
    whole = "" if linkage == "average" else " HAVING count(*) = (CASE WHEN a IN (SELECT a FROM m{k}) THEN 2 ELSE 1 END) * (CASE WHEN b IN (SELECT a FROM m{k}) THEN 2 ELSE 1 END)"
    for k in range(rounds):
        parts.append(f"r{k} AS MATERIALIZED (SELECT a, b, {near} AS near, x.z + y.z AS z FROM s{k} JOIN z{k} x ON x.c = a JOIN z{k} y ON y.c = b)")
        parts.append(f"n{k} AS (SELECT c, min({{'f': -near, 'a': a, 'b': b}}) AS key FROM (SELECT unnest([a, b]) AS c, near, a, b FROM r{k}) GROUP BY c)")
        parts.append(f"m{k} AS MATERIALIZED (SELECT {k + 1} AS round, a, b, 1 - near / top.w AS height, z AS size FROM r{k}, top WHERE (a, b) IN (SELECT (key.a, key.b) FROM n{k} GROUP BY key HAVING count(*) = 2))")
        parts.append(f"t{k} AS (SELECT least(x, y) AS a, greatest(x, y) AS b, s FROM (SELECT coalesce(p.a, s.a) AS x, coalesce(q.a, s.b) AS y, s.s FROM s{k} s LEFT JOIN m{k} p ON p.b = s.a LEFT JOIN m{k} q ON q.b = s.b) WHERE x <> y)")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT a, b, {new} AS s FROM t{k} GROUP BY a, b{whole.format(k=k)})")
        parts.append(f"z{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.size, z) AS z FROM z{k} LEFT JOIN m{k} m ON m.a = c WHERE c NOT IN (SELECT b FROM m{k}))")
    found = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(rounds))
    rest = f"SELECT (SELECT max(round) + 1 FROM found), (SELECT min(c) FROM z{rounds}), c, 1.0::DOUBLE, NULL FROM z{rounds} WHERE c > (SELECT min(c) FROM z{rounds})"
    return ", ".join(parts) + f", found AS MATERIALIZED ({found}) SELECT round::INT AS round, a, b, round(height, 9) AS height, size FROM (SELECT * FROM found UNION ALL {rest})"


def _tree(spark: SparkSession, sf: str, linkage: str) -> DataFrame:
    return hierarchy.dendrogram(_strong(spark, sf), linkage, "w").withColumn("height", F.round("height", 9))


@query(_tree_sql("average", 40))
def average_linkage(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, "average")


@query(_tree_sql("complete", 20))
def complete_linkage(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf, "complete")


@query(f"""WITH RECURSIVE {STRONG}, top AS (SELECT max(w) AS w FROM strong), heavy AS (SELECT u, v FROM adj, top WHERE 1 - adj.w / top.w <= 0.8::DOUBLE),
r(id, root) AS (SELECT u, u FROM deg UNION SELECT v, root FROM r JOIN heavy ON u = r.id) SELECT id, min(root) AS cluster FROM r GROUP BY id""")
def single_linkage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage cut at 0.8, which is the components of the edges that near."""
    g = _strong(spark, sf)
    return hierarchy.clusters_at(g, hierarchy.dendrogram(g, "single", "w"), 0.8)


@query(f"""WITH RECURSIVE {STRONG}, r(id, root) AS (SELECT u, u FROM deg UNION SELECT v, root FROM r JOIN adj ON u = r.id)
SELECT count(*) AS edges, count(*) = (SELECT count(*) FROM deg) - 1 AS whole FROM (SELECT u FROM deg WHERE u > (SELECT min(u) FROM deg))""")
def single_linkage_size(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    n = g.ids().agg(F.count("*").alias("n"))
    return hierarchy.dendrogram(g, "single", "w").agg(F.count("*").alias("edges")).join(F.broadcast(n)).select("edges", (F.col("edges") == F.col("n") - 1).alias("whole"))  # one row each


@query(None)
def spectral_partition(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.partition(_strong(spark, sf), 4)


@query(f"""WITH {STRONG}, p AS (SELECT u AS id, u % 4 AS part FROM deg), e AS (SELECT a.part AS a, b.part AS b FROM strong JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE a.part <> b.part),
c AS (SELECT part, count(*) AS cut FROM (SELECT unnest([a, b]) AS part FROM e) GROUP BY part), s AS (SELECT part, count(*) AS size FROM p GROUP BY part)
SELECT part, size, coalesce(cut, 0) AS cut, size * (SELECT count(*) FROM s) / (SELECT sum(size) FROM s) AS balance FROM s LEFT JOIN c USING (part)""")
def partition_report(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return spectral.partition_report(g, g.ids().select("id", F.pmod("id", F.lit(4)).alias("part")))


@query(f"""WITH {STRONG}, m AS (SELECT count(*)::DOUBLE AS m FROM strong), n AS (SELECT s_suppkey AS id, s_nationkey AS c FROM supplier),
tot AS (SELECT c, sum(d) AS tot FROM deg JOIN n ON id = u GROUP BY c), ins AS (SELECT x.c, count(*) * 2 AS inside FROM strong JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE x.c = y.c GROUP BY 1),
l AS (SELECT a.u AS id, n.c AS community, count(*) AS links FROM adj a JOIN n ON n.id = a.v GROUP BY ALL)
SELECT l.id, community, round(((coalesce(inside, 0) + links) / (2 * m) - ((tot + d) / (2 * m)) ** 2) - (coalesce(inside, 0) / (2 * m) - (tot / (2 * m)) ** 2 - (d / (2 * m)) ** 2), 9) AS gain
FROM l JOIN n ON n.id = l.id AND n.c <> community JOIN deg ON deg.u = l.id JOIN tot ON tot.c = community LEFT JOIN ins ON ins.c = community, m""")
def move_gains(spark: SparkSession, sf: str) -> DataFrame:
    """What modularity gains when a supplier joins another nation around it."""
    g = _strong(spark, sf)
    nations = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return communities.neighbour_gains(g, nations).select("id", "community", F.round("gain", 9).alias("gain"))


_BIG = f"{TRADE}, big AS (SELECT src, dst FROM trade WHERE src <> dst AND w > (SELECT quantile_disc(w, 0.9) FROM trade))"


def _big_trade(spark: SparkSession, sf: str) -> Graph:
    """The heaviest tenth of the trade between nations, directed."""
    t = derived.trade(spark, sf)
    cut = t.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY w)").alias("cut"))
    return Graph(t.join(F.broadcast(cut), F.col("w") > F.col("cut")).where("src <> dst").select("src", "dst"), None, True).stored()  # one row is broadcast


def _peel_sql(rounds: int = 25) -> str:
    parts = ["v0 AS (SELECT src AS id FROM big UNION SELECT dst FROM big)"]
    for k in range(rounds):
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT id FROM v{k} WHERE id IN (SELECT dst FROM big WHERE src IN (SELECT id FROM v{k})))")
    return ", ".join(parts)


@query(f"""WITH RECURSIVE {_BIG}, {_peel_sql()}, f AS MATERIALIZED (SELECT dst AS id, min(src) AS back FROM big WHERE src IN (SELECT id FROM v25) AND dst IN (SELECT id FROM v25) GROUP BY dst),
walk(start, id, k) AS (SELECT id, id, 0 FROM f UNION ALL SELECT start, back, k + 1 FROM walk JOIN f USING (id) WHERE k < 50),
ring AS (SELECT DISTINCT id FROM walk WHERE k = 50), c AS (SELECT start AS id, min(w.id) AS cycle FROM walk w WHERE start IN (SELECT id FROM ring) GROUP BY start)
SELECT cycle, min(k)::INT AS position, c.id FROM c JOIN walk w ON w.start = c.id AND w.id = cycle GROUP BY ALL""")
def cycle_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    return certificates.cycles(_big_trade(spark, sf))


@query(f"""WITH RECURSIVE {STRONG}, r(id, root) AS (SELECT u, u FROM deg UNION SELECT v, root FROM r JOIN adj ON u = r.id)
SELECT (SELECT count(*) FROM deg) - count(DISTINCT root) AS edges, count(DISTINCT root) AS trees FROM (SELECT id, min(root) AS root FROM r GROUP BY id)""")
def spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    n = g.ids().agg(F.count("*").alias("n"))
    return hierarchy.spanning_forest(g).agg(F.count("*").alias("edges")).join(F.broadcast(n)).select("edges", (F.col("n") - F.col("edges")).alias("trees"))  # one row each


@query(None)
def edge_certificate(spark: SparkSession, sf: str) -> DataFrame:
    return certificates.sparse_certificate(_strong(spark, sf), 3)


def _colours_sql(rounds: int = 8) -> str:
    parts = [f"WITH {STRONG}, c0 AS (SELECT u AS id, -1::BIGINT AS colour FROM deg)"]
    for k in range(rounds):
        parts.append(f"s{k} AS (SELECT a.u AS id, list_sort(list(c.colour)) AS seen FROM adj a JOIN c{k} c ON c.id = a.v GROUP BY a.u)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY colour, seen) AS colour FROM c{k} JOIN s{k} USING (id))")
    return ", ".join(parts) + f" SELECT id, colour FROM c{rounds}"


@query(_colours_sql())
def colour_refinement(spark: SparkSession, sf: str) -> DataFrame:
    return certificates.colour_classes(_strong(spark, sf))


_FORCES = f"""{STRONG}, p AS (SELECT a.u, a.v, b.v AS w FROM adj a JOIN adj b ON a.u = b.u AND a.v <> b.v ANTI JOIN adj c ON c.u = a.v AND c.v = b.v),
x AS MATERIALIZED (SELECT {{'src': u, 'dst': v}} AS a, {{'src': u, 'dst': w}} AS b FROM p UNION ALL SELECT {{'src': v, 'dst': u}}, {{'src': w, 'dst': u}} FROM p),
r(arc, root) USING KEY (arc) AS (SELECT {{'src': u, 'dst': v}}, {{'src': u, 'dst': v}} FROM adj UNION SELECT x.b, min(r.root) FROM r JOIN x ON x.a = r.arc LEFT JOIN recurring.r o ON o.arc = x.b WHERE r.root < o.root GROUP BY x.b)"""


@query(f"WITH RECURSIVE {_FORCES} SELECT a.arc.src AS src, a.arc.dst AS dst FROM r a JOIN r b ON b.arc.src = a.arc.dst AND b.arc.dst = a.arc.src WHERE a.root = b.root AND a.arc.src < a.arc.dst")
def orientation_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that no transitive orientation can direct."""
    return certificates.orientation_conflicts(certificates.forced_arcs(_strong(spark, sf)))


@query(f"WITH RECURSIVE {_FORCES} SELECT count(DISTINCT root) AS classes, count(*) AS arcs FROM r")
def implication_classes(spark: SparkSession, sf: str) -> DataFrame:
    return certificates.forced_arcs(_strong(spark, sf)).agg(F.countDistinct("class").alias("classes"), F.count("*").alias("arcs"))


@query(f"""WITH RECURSIVE {STRONG}, far AS MATERIALIZED (SELECT x.u AS x, y.u AS id FROM deg x JOIN deg y ON x.u <> y.u ANTI JOIN adj a ON a.u = x.u AND a.v = y.u),
e AS MATERIALIZED (SELECT f.x, a.u, a.v FROM far f JOIN adj a ON a.u = f.id JOIN far g ON g.x = f.x AND g.id = a.v),
c(x, id, component) USING KEY (x, id) AS (SELECT x, id, id FROM far UNION SELECT c.x, e.v, min(c.component) FROM c JOIN e ON e.x = c.x AND e.u = c.id LEFT JOIN recurring.c o ON o.x = c.x AND o.id = e.v WHERE c.component < o.component GROUP BY c.x, e.v)
SELECT ab.x AS a, ab.id AS b, ac.id AS c FROM c ab JOIN c ac ON ac.x = ab.x AND ab.x < ab.id AND ab.id < ac.id AND ac.component = ab.component JOIN c ba ON ba.x = ab.id AND ba.id = ab.x JOIN c bc ON bc.x = ab.id AND bc.id = ac.id AND bc.component = ba.component
JOIN c ca ON ca.x = ac.id AND ca.id = ab.x JOIN c cb ON cb.x = ac.id AND cb.id = ab.id AND cb.component = ca.component""")
def asteroidal_triples(spark: SparkSession, sf: str) -> DataFrame:
    return certificates.asteroidal_triples(_strong(spark, sf))


def _elimination_sql(rounds: int = 30) -> str:
    parts = [f"WITH {STRONG}, l0 AS (SELECT u AS id FROM deg), e0 AS (SELECT u, v FROM adj)"]
    for k in range(rounds):
        parts.append(f"d{k} AS MATERIALIZED (SELECT id, count(v) AS d FROM l{k} LEFT JOIN e{k} ON u = id GROUP BY id)")
        parts.append(f"g{k} AS MATERIALIZED (SELECT x.id, {k + 1} AS round, x.d AS degree FROM d{k} x WHERE NOT EXISTS (SELECT 1 FROM e{k} e JOIN d{k} y ON y.id = e.v WHERE e.u = x.id AND (y.d, y.id) < (x.d, x.id)))")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT u, v FROM e{k} WHERE u NOT IN (SELECT id FROM g{k}) AND v NOT IN (SELECT id FROM g{k}) UNION SELECT a.v, b.v FROM e{k} a JOIN e{k} b ON a.u = b.u AND a.v <> b.v WHERE a.u IN (SELECT id FROM g{k}))")
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT id FROM l{k} WHERE id NOT IN (SELECT id FROM g{k}))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT id, round::INT AS round, degree FROM g{k}" for k in range(rounds))


@query(_elimination_sql())
def elimination_order(spark: SparkSession, sf: str) -> DataFrame:
    return certificates.elimination(_strong(spark, sf))


@query(f"WITH {STRONG} SELECT src, dst, w FROM strong WHERE w % 3 = 1")
def typed_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return Graph(g.edges.withColumn("type", F.concat(F.lit("t"), F.col("w") % 3))).of_types(["t1"]).edges.select("src", "dst", "w")


@query(f"WITH {STRONG}, e AS (SELECT * FROM strong WHERE w >= (SELECT avg(w) FROM strong)) SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 5000 OR s_suppkey IN (SELECT src FROM e UNION SELECT dst FROM e)")
def either_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with a large balance or on an edge of at least mean weight."""
    g = _strong(spark, sf)
    mean = g.edges.agg(F.avg("w")).first()[0]
    vertices = derived.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return Graph(g.edges, vertices).either(F.col("s_acctbal") > 5000, F.col("w") >= F.lit(mean)).vertices.select("id")


@query(f"WITH {STRONG} SELECT u AS src, string_agg(v || ':' || w, ' ' ORDER BY v) AS targets FROM adj GROUP BY u")
def compressed_rows(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    rows = Graph(g.edges.select("src", "dst", F.col("w").alias("weight"))).csr()
    return rows.select("src", F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["dst"], t["weight"].cast("long"))), " ").alias("targets"))


@query(None)
def core_periphery(spark: SparkSession, sf: str) -> DataFrame:
    return classes.core_periphery(_strong(spark, sf))


def _told(declared: dict[str, object]) -> str:
    """SQL of the validation rows of declared values over a table `actual` (property, actual)."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    rows = ", ".join(f"('{k}', '{text(v)}')" for k, v in declared.items())
    return f"SELECT property, expected, actual, expected = actual AS valid, CASE WHEN expected = actual THEN '' ELSE property || ' is ' || actual || ', declared as ' || expected END AS message FROM (VALUES {rows}) d(property, expected) JOIN actual USING (property)"


_STRONG_SPEC = {"components": 1, "regular": True, "simple": True, "bipartite": False, "complete": True, "cograph": False, "claw_free": True, "planar_by_edges": True, "triangle_free": False}


@query(f"""WITH RECURSIVE {STRONG}, r(id, root, side) AS (SELECT u, u, 0 FROM deg UNION SELECT v, root, 1 - side FROM r JOIN adj ON u = r.id), g AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM strong) AS m),
o AS (SELECT a.u AS c, a.v AS x, b.v AS y FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v ANTI JOIN strong s ON s.src = a.v AND s.dst = b.v),
actual AS (SELECT unnest(['components', 'regular', 'simple', 'bipartite', 'complete', 'cograph', 'claw_free', 'planar_by_edges', 'triangle_free']) AS property, unnest([
  (SELECT count(DISTINCT root) FROM (SELECT id, min(root) AS root FROM r GROUP BY id))::VARCHAR, (SELECT min(d) = max(d) FROM deg)::VARCHAR, 'true', (NOT EXISTS (SELECT 1 FROM r WHERE id = root AND side = 1))::VARCHAR, (2 * m = n * (n - 1))::VARCHAR,
  (NOT EXISTS (SELECT 1 FROM strong e JOIN adj a ON a.u = e.src AND a.v <> e.dst JOIN adj d ON d.u = e.dst AND d.v <> e.src AND d.v <> a.v WHERE NOT EXISTS (SELECT 1 FROM adj WHERE u = a.v AND v = e.dst) AND NOT EXISTS (SELECT 1 FROM adj WHERE u = e.src AND v = d.v) AND NOT EXISTS (SELECT 1 FROM adj WHERE u = a.v AND v = d.v)))::VARCHAR,
  (NOT EXISTS (SELECT 1 FROM o p JOIN o q ON p.c = q.c AND p.x = q.x AND p.y < q.y JOIN o w ON w.c = p.c AND w.x = p.y AND w.y = q.y))::VARCHAR, (m <= 3 * n - 6)::VARCHAR,
  (NOT EXISTS (SELECT 1 FROM strong x JOIN strong y ON x.dst = y.src JOIN strong z ON z.src = x.src AND z.dst = y.dst))::VARCHAR]) AS actual FROM g) {_told(_STRONG_SPEC)}""")
def validated_strong(spark: SparkSession, sf: str) -> DataFrame:
    """The strong graph against what is declared of it, partly wrongly."""
    return analyze.validate(_strong(spark, sf), _STRONG_SPEC)


_TRADE_SPEC = {"directed": True, "acyclic": True, "dag": False, "tournament": True, "self_loops": False, "vertices": 25}


@query(f"""WITH {_BIG}, {_peel_sql()}, ids AS (SELECT src AS id FROM big UNION SELECT dst FROM big), actual AS (SELECT unnest(['directed', 'acyclic', 'dag', 'tournament', 'self_loops', 'vertices']) AS property, unnest([
  'true', (NOT EXISTS (SELECT 1 FROM v25))::VARCHAR, (NOT EXISTS (SELECT 1 FROM v25))::VARCHAR,
  ((SELECT count(*) FROM big) = (SELECT count(*) * (count(*) - 1) / 2 FROM ids) AND NOT EXISTS (SELECT 1 FROM big a JOIN big b ON a.src = b.dst AND a.dst = b.src))::VARCHAR, 'false', (SELECT count(*) FROM ids)::VARCHAR]) AS actual) {_told(_TRADE_SPEC)}""")
def validated_trade(spark: SparkSession, sf: str) -> DataFrame:
    """The heaviest trade, a directed graph without loops, against what is declared of it."""
    return analyze.validate(_big_trade(spark, sf), _TRADE_SPEC)


_EVENT_SPEC = {"self_loops": True, "complete": False, "multigraph": False, "tournament": False}


@query(f"""WITH {TRANSITIONS}, n AS (SELECT count(*) AS n FROM (SELECT src AS id FROM transitions UNION SELECT dst FROM transitions)), actual AS (SELECT unnest(['self_loops', 'complete', 'multigraph', 'tournament']) AS property, unnest([
  (EXISTS (SELECT 1 FROM transitions WHERE src = dst))::VARCHAR, ((SELECT count(*) FROM transitions WHERE src <> dst) = n * (n - 1))::VARCHAR, 'false', 'false']) AS actual FROM n) {_told(_EVENT_SPEC)}""")
def validated_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.validate(Graph(derived.transitions(spark, sf).select("src", "dst"), None, True), _EVENT_SPEC)


@query("""WITH RECURSIVE e AS (SELECT n_regionkey::BIGINT AS src, 100 + n_nationkey::BIGINT AS dst FROM nation UNION ALL SELECT 100 + s_nationkey, 1000 + s_suppkey FROM supplier),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), t(id, path) AS (SELECT id, [id] FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN e ON src = t.id),
leaf AS (SELECT * FROM t WHERE id NOT IN (SELECT src FROM e)),
c AS (SELECT t.id, len(t.path) - 1 AS depth, count(*) FILTER (WHERE list_contains(l.path, t.id)) AS leaves, count(*) FILTER (WHERE l.path < t.path AND NOT list_contains(l.path, t.id)) AS first FROM t, leaf l GROUP BY t.id, t.path)
SELECT id, depth::INT AS depth, leaves, first + (leaves - 1) / 2 AS x, depth::DOUBLE AS y FROM c""")
def forest_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Regions over their nations over their suppliers."""
    nations = derived.table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    suppliers = derived.table(spark, sf, "supplier").select((F.col("s_nationkey") + 100).cast("long").alias("src"), (F.col("s_suppkey") + 1000).cast("long").alias("dst"))
    return layout.forest_layout(Graph(nations.union(suppliers), None, True))
