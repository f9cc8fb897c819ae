"""Queries over graphs derived from the tables, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import Graph
from meshwork.operators import blocks, communities, expansion, information, motifs, paths, traversal, truth
from meshwork.plans import analyze, classes
from meshwork.sources import derived

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Shared table expressions of the SQL side.
CITES = "cites AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
COSUPP = """os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
cosupp AS (SELECT a.s AS src, b.s AS dst, count(*) AS w FROM os a JOIN os b ON a.o = b.o AND a.s < b.s GROUP BY ALL)"""
STRONG = f"""{COSUPP},
strong AS (SELECT * FROM cosupp WHERE w > (SELECT quantile_disc(w, 0.95) FROM cosupp)),
adj AS (SELECT src AS u, dst AS v, w FROM strong UNION ALL SELECT dst, src, w FROM strong),
deg AS (SELECT u, count(*) AS d FROM adj GROUP BY u)"""
TRADE = """trade AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
TRANSITIONS = """steps AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
transitions AS (SELECT src, dst, count(*) AS w FROM steps WHERE dst IS NOT NULL GROUP BY ALL)"""
MEMBER = "member AS (SELECT s_suppkey AS id, s_nationkey AS community FROM supplier)"
COMMON = """pairs AS (SELECT s.src, s.dst, count(*) AS common, sum(1 / ln(d.d + 2)) AS adamic
  FROM strong s JOIN adj a ON a.u = s.src JOIN adj b ON b.u = s.dst AND b.v = a.v JOIN deg d ON d.u = a.v GROUP BY ALL),
c AS (SELECT s.src, s.dst, coalesce(common, 0) AS common, coalesce(adamic, 0) AS adamic, x.d AS ds, y.d AS dt
  FROM strong s LEFT JOIN pairs USING (src, dst) JOIN deg x ON x.u = s.src JOIN deg y ON y.u = s.dst)"""


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _strong(spark: SparkSession, sf: str) -> Graph:
    """The edges are computed once: what follows reads them several times."""
    return Graph(derived.strong(spark, sf)).stored()


def _seeds(g: Graph) -> DataFrame:
    """The three smallest vertices."""
    return g.ids().orderBy("id").limit(3)


SEEDS = "s AS (SELECT u AS id FROM deg ORDER BY u LIMIT 3)"


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return derived.suppliers(spark, sf).withColumnRenamed("nation", "community")


@query(f"WITH {CITES} SELECT a.src AS a, b.src AS b, count(*) AS n FROM cites a JOIN cites b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 2")
def bibliographic_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.couplings(derived.cites(spark, sf), 2)


@query(f"WITH {CITES} SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM cites a JOIN cites b ON a.src = b.src AND a.dst < b.dst GROUP BY ALL HAVING count(*) >= 2")
def co_citation(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.co_citations(derived.cites(spark, sf), 2)


@query(f"WITH {COSUPP} SELECT * FROM cosupp")
def shared_orders(spark: SparkSession, sf: str) -> DataFrame:
    return derived.cosupp(spark, sf)


@query(f"WITH {TRADE} SELECT * FROM trade")
def trade_graph(spark: SparkSession, sf: str) -> DataFrame:
    return derived.trade(spark, sf)


@query(f"WITH {TRANSITIONS} SELECT * FROM transitions")
def event_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return derived.transitions(spark, sf)


@query(f"WITH {TRANSITIONS} SELECT src, -sum(w / t * log2(w / t)) AS entropy FROM (SELECT src, w, sum(w) OVER (PARTITION BY src) AS t FROM transitions) GROUP BY src")
def transition_entropy(spark: SparkSession, sf: str) -> DataFrame:
    t = derived.transitions(spark, sf)
    total = t.groupBy("src").agg(F.sum("w").alias("t"))
    p = F.col("w") / F.col("t")
    return t.join(total, "src").groupBy("src").agg((-F.sum(p * F.log2(p))).alias("entropy"))


@query(f"WITH {STRONG} SELECT coalesce(o.id, i.id) AS id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM (SELECT src AS id, count(*) AS n FROM strong GROUP BY 1) o FULL JOIN (SELECT dst AS id, count(*) AS n FROM strong GROUP BY 1) i ON o.id = i.id")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return _strong(spark, sf).degrees()


@query(f"WITH {COSUPP} SELECT c.* FROM cosupp c JOIN supplier a ON c.src = a.s_suppkey JOIN supplier b ON c.dst = b.s_suppkey WHERE a.s_nationkey < 10 AND b.s_nationkey < 10")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    keep = derived.suppliers(spark, sf).where("nation < 10")
    return Graph(derived.cosupp(spark, sf)).induced(keep).edges


@query(f"WITH {COSUPP} SELECT c.* FROM cosupp c JOIN supplier a ON c.src = a.s_suppkey JOIN supplier b ON c.dst = b.s_suppkey WHERE a.s_acctbal > 0 AND b.s_acctbal > 0 AND w >= 25")
def filtered_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    vertices = derived.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return Graph(derived.cosupp(spark, sf), vertices).filtered(F.col("s_acctbal") > 0, F.col("w") >= 25).edges


@query(f"""WITH {STRONG}, {SEEDS},
ball AS (SELECT id FROM s UNION SELECT v FROM adj JOIN s ON u = id)
SELECT src, dst, w FROM strong WHERE src IN (SELECT id FROM ball) AND dst IN (SELECT id FROM ball)""")
def ego_network(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return traversal.ego_network(g, _seeds(g), 1).edges


@query(f"WITH {STRONG} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM strong x JOIN strong y ON x.dst = y.src JOIN strong z ON z.src = x.src AND z.dst = y.dst")
def triangles(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.triangles(_strong(spark, sf))


@query(f"""WITH {STRONG}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM strong x JOIN strong y ON x.dst = y.src JOIN strong z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT id, count(*) AS k FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id)
SELECT u AS id, coalesce(k, 0) AS triangles, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(k, 0) / (d * (d - 1)) ELSE 0 END AS clustering FROM deg LEFT JOIN n ON n.id = u""")
def clustering(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.triangle_counts(_strong(spark, sf))


@query(f"WITH {STRONG} SELECT u AS hub, d AS leaves FROM deg WHERE d >= 8")
def stars(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.stars(_strong(spark, sf), 8)


@query(f"""WITH {STRONG}, n AS (SELECT s.src, s.dst, count(*) AS k FROM strong s JOIN adj a ON a.u = s.src JOIN adj b ON b.u = s.dst AND a.v = b.v GROUP BY ALL)
SELECT src AS u, dst AS v, coalesce(k, 0) AS support FROM strong LEFT JOIN n USING (src, dst)""")
def triangle_support(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.support(_strong(spark, sf))


def _truss_sql(rounds: int = 16) -> str:
    parts = [f"WITH {STRONG}, t0 AS (SELECT src, dst FROM strong)"]
    for k in range(rounds):
        both = f"SELECT src AS u, dst AS v FROM t{k} UNION ALL SELECT dst, src FROM t{k}"
        parts.append(f"b{k} AS MATERIALIZED ({both}), t{k + 1} AS MATERIALIZED (SELECT DISTINCT t.src, t.dst FROM t{k} t JOIN b{k} a ON a.u = t.src JOIN b{k} b ON b.u = t.dst AND b.v = a.v)")
    return ", ".join(parts) + f" SELECT src, dst FROM t{rounds}"


@query(_truss_sql())
def k_truss(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.k_truss(_strong(spark, sf), 3)


@query(f"""WITH {STRONG} SELECT count(*) AS n FROM strong e JOIN adj a ON a.u = e.src AND a.v <> e.dst JOIN adj d ON d.u = e.dst AND d.v <> e.src AND d.v <> a.v
WHERE NOT EXISTS (SELECT 1 FROM adj WHERE u = a.v AND v = e.dst) AND NOT EXISTS (SELECT 1 FROM adj WHERE u = e.src AND v = d.v) AND NOT EXISTS (SELECT 1 FROM adj WHERE u = a.v AND v = d.v)""")
def induced_p4(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.induced_paths4(_strong(spark, sf))


@query(f"""WITH {STRONG}, {COMMON}, g AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM strong) AS m), q AS (SELECT pow(2.0 * m / (n * (n - 1)), 2) AS e FROM g),
j AS (SELECT c.*, common / (ds + dt - common) AS j FROM c)
SELECT src, dst, j + 1e-10 AS jaccard, least(1.0, adamic / (least(ds, dt) / ln(4))) + 1e-10 AS adamic_adar, greatest(1e-10, least(1.0, (j - e) / (1 - e))) AS density_normalised FROM j, q""")
def edge_information(spark: SparkSession, sf: str) -> DataFrame:
    return information.structural(_strong(spark, sf))


@query(f"""WITH {STRONG}, {COMMON}, g AS (SELECT count(*) AS n FROM deg)
SELECT src, dst, exp(-0.5 * (ln(ds + 1) + ln(dt + 1))) AS degree_penalty, ln(n / (ds + 1) + 1e-10) * ln(n / (dt + 1) + 1e-10) AS idf FROM c, g""")
def edge_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    return information.degree_modifiers(_strong(spark, sf))


@query(f"""WITH {STRONG}, k AS (SELECT src, dst, s_nationkey AS kind FROM strong JOIN supplier ON src = s_suppkey), t AS (SELECT count(*) AS t FROM k)
SELECT src, dst, kind, -ln((count(*) OVER (PARTITION BY kind) + 1e-10) / (t + 1e-10)) / -ln(1e-10 / (t + 1e-10)) AS rarity FROM k, t""")
def type_rarity(spark: SparkSession, sf: str) -> DataFrame:
    e = derived.strong(spark, sf).join(derived.suppliers(spark, sf).withColumnRenamed("id", "src"), "src")
    return information.rarity(e, F.col("nation"))


def _pairs(g: Graph) -> DataFrame:
    """The smallest vertex with each of the three largest."""
    low = g.ids().agg(F.min("id").alias("src"))
    return g.ids().orderBy(F.desc("id")).limit(3).select(F.col("id").alias("dst")).join(F.broadcast(low)).select("src", "dst")  # one row is broadcast


_PATHS = f"""{STRONG}, e AS (SELECT (SELECT min(u) FROM deg) AS s, u AS t FROM deg ORDER BY u DESC LIMIT 3),
walk AS MATERIALIZED (
  SELECT s, t, [s, a.v] AS nodes FROM e JOIN adj a ON a.u = s WHERE a.v = t
  UNION ALL SELECT s, t, [s, a.v, b.v] FROM e JOIN adj a ON a.u = s JOIN adj b ON b.u = a.v WHERE b.v = t AND a.v <> t
  UNION ALL SELECT s, t, [s, a.v, b.v, c.v] FROM e JOIN adj a ON a.u = s JOIN adj b ON b.u = a.v AND b.v <> s JOIN adj c ON c.u = b.v WHERE c.v = t AND a.v <> t AND b.v <> t
)"""
_STEPS = "step AS (SELECT s, t, nodes, nodes[i] AS x, nodes[i + 1] AS y, least(nodes[i], nodes[i + 1]) AS a, greatest(nodes[i], nodes[i + 1]) AS b FROM (SELECT s, t, nodes, unnest(range(1, len(nodes))) AS i FROM walk))"
_BEST = "SELECT s AS src, t AS dst, array_to_string(nodes, '-') AS path, (row_number() OVER (PARTITION BY s, t ORDER BY round(score, 9) DESC, len(nodes), nodes))::INT AS position, round(score, 9) AS score FROM score QUALIFY position <= 5"


def _found(g: Graph) -> DataFrame:
    return paths.simple_paths(g, _pairs(g), 3)


def _best(scored: DataFrame) -> DataFrame:
    best = paths.top_paths(scored, 5, F.round("score", 9))
    return best.select("src", "dst", F.array_join("nodes", "-").alias("path"), "position", F.round("score", 9).alias("score"))


@query(f"WITH {_PATHS} SELECT s AS src, t AS dst, array_to_string(nodes, '-') AS path, (len(nodes) - 1)::INT AS hops FROM walk")
def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _found(_strong(spark, sf)).select("src", "dst", F.array_join("nodes", "-").alias("path"), "hops")


@query(f"""WITH {_PATHS}, {COMMON}, mi AS (SELECT src, dst, common / (ds + dt - common) + 1e-10 AS mi FROM c), {_STEPS},
score AS (SELECT s, t, nodes, exp(avg(ln(mi + 1e-10)) - 0.1 * count(*)) AS score FROM step JOIN mi ON mi.src = a AND mi.dst = b GROUP BY ALL) {_BEST}""")
def ranked_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    mi = information.structural(g).select("src", "dst", F.col("jaccard").alias("mi"))
    return _best(paths.scored(_found(g), mi, 0.1))


@query(f"""WITH {_PATHS}, {COMMON}, mi AS (SELECT src, dst, common / (ds + dt - common) + 1e-10 AS mi FROM c), {_STEPS},
score AS (SELECT s, t, nodes, avg(mi) AS score FROM step JOIN mi ON mi.src = a AND mi.dst = b GROUP BY ALL) {_BEST}""")
def jaccard_mean_ranking(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return _best(paths.by_edges(_found(g), information.structural(g).select("src", "dst", F.col("jaccard").alias("value"))))


@query(f"WITH {_PATHS}, {_STEPS}, score AS (SELECT s, t, nodes, avg(w) AS score FROM step JOIN strong ON src = a AND dst = b GROUP BY ALL) {_BEST}")
def weight_ranking(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return _best(paths.by_edges(_found(g), g.edges.select("src", "dst", F.col("w").alias("value"))))


@query(f"WITH {_PATHS}, score AS (SELECT s, t, nodes, sum(d) AS score FROM (SELECT s, t, nodes, unnest(nodes) AS u FROM walk) JOIN deg USING (u) GROUP BY ALL) {_BEST}")
def degree_sum_ranking(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return _best(paths.by_vertices(_found(g), g.degrees().select("id", F.col("degree").alias("score"))))


@query(f"WITH {_PATHS}, score AS (SELECT s, t, nodes, avg(d) AS score FROM (SELECT s, t, nodes, unnest(nodes) AS u FROM walk) JOIN deg USING (u) GROUP BY ALL) {_BEST}")
def degree_mean_ranking(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return _best(paths.by_vertices(_found(g), g.degrees().select("id", F.col("degree").alias("score")), "mean"))


@query(f"WITH {_PATHS}, score AS (SELECT s, t, nodes, 1.0::DOUBLE / len(nodes) AS score FROM walk) {_BEST}")
def length_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _best(paths.by_length(_found(_strong(spark, sf))))


@query(f"WITH {_PATHS}, score AS (SELECT s, t, nodes, ('0x' || left(md5('42:' || array_to_string(nodes, '-')), 13))::BIGINT / 4503599627370496.0::DOUBLE AS score FROM walk) {_BEST}")
def random_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _best(paths.at_random(_found(_strong(spark, sf))))


@query(f"WITH {_PATHS}, short AS (SELECT *, min(len(nodes)) OVER (PARTITION BY s, t) AS least FROM walk) SELECT s AS src, t AS dst, array_to_string(nodes, '-') AS path, (len(nodes) - 1)::INT AS hops FROM short WHERE len(nodes) = least")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return paths.shortest_paths(g, _pairs(g)).select("src", "dst", F.array_join("nodes", "-").alias("path"), "hops")


@query(f"WITH {_PATHS} SELECT s AS src, t AS dst, count(*) AS paths, avg(len(nodes)) AS mean_length, stddev_pop(len(nodes)) AS deviation, min(len(nodes))::INT AS least, max(len(nodes))::INT AS greatest, len(list_distinct(flatten(list(nodes))))::BIGINT AS vertices, len(list_distinct(flatten(list(edges))))::BIGINT AS edges FROM (SELECT *, list_transform(range(1, len(nodes)), lambda i: least(nodes[i], nodes[i + 1]) || '-' || greatest(nodes[i], nodes[i + 1])) AS edges FROM walk) GROUP BY ALL")
def path_measures(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_measures(_found(_strong(spark, sf)))


@query(f"WITH {_PATHS}, c AS (SELECT s, t, len(nodes) AS k, count(*) AS c FROM walk GROUP BY ALL), g AS (SELECT s, t, sum(c) AS total, count(*) AS kinds FROM c GROUP BY ALL) SELECT s AS src, t AS dst, CASE WHEN max(kinds) > 1 THEN round(-sum(c / total * log2(c / total)) / log2(max(kinds)), 9) ELSE 0 END AS diversity FROM c JOIN g USING (s, t) GROUP BY ALL")
def path_length_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return paths.length_entropy(_found(_strong(spark, sf))).select("src", "dst", F.round("diversity", 9).alias("diversity"))


@query(f"""WITH {STRONG}, k AS (SELECT s_suppkey AS id, s_nationkey % 3 AS kind FROM supplier)
SELECT a.u || '-' || a.v || '-' || b.v AS path FROM adj a JOIN adj b ON b.u = a.v AND b.v <> a.u JOIN k x ON x.id = a.u AND x.kind = 0 JOIN k y ON y.id = a.v AND y.kind = 1 JOIN k z ON z.id = b.v AND z.kind = 2""")
def typed_paths(spark: SparkSession, sf: str) -> DataFrame:
    kinds = derived.suppliers(spark, sf).select("id", (F.col("nation") % 3).alias("type"))
    return truth.typed_paths(_strong(spark, sf), kinds, ["0", "1", "2"]).select(F.array_join("nodes", "-").alias("path"))


@query(None)
def sampled_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return truth.sampled_paths(g, _pairs(g)).select("src", "dst", "walk", F.array_join("nodes", "-").alias("path"), "hops")


@query(f"WITH {_PATHS} SELECT id, count(*) AS paths FROM (SELECT unnest(nodes) AS id FROM walk) GROUP BY id")
def path_salience(spark: SparkSession, sf: str) -> DataFrame:
    return paths.salience(_found(_strong(spark, sf)))


@query(f"""WITH {_PATHS} SELECT x.s AS src, x.t AS dst, avg(1 - len(list_intersect(x.nodes, y.nodes)) / len(list_distinct(list_concat(x.nodes, y.nodes)))) AS distance
FROM walk x JOIN walk y ON x.s = y.s AND x.t = y.t AND x.nodes < y.nodes GROUP BY ALL""")
def path_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return paths.mean_jaccard_distance(_found(_strong(spark, sf)))


@query(f"""WITH {_PATHS}, w AS (SELECT *, list_transform(range(1, len(nodes)), lambda i: least(nodes[i], nodes[i + 1]) || '-' || greatest(nodes[i], nodes[i + 1])) AS es FROM walk)
SELECT x.s AS src, x.t AS dst, avg(1 - len(list_intersect(x.es, y.es)) / len(list_distinct(list_concat(x.es, y.es)))) AS distance FROM w x JOIN w y ON x.s = y.s AND x.t = y.t AND x.nodes < y.nodes GROUP BY ALL""")
def path_edge_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return paths.mean_edge_jaccard_distance(_found(_strong(spark, sf)))


@query(f"WITH {_PATHS}, {_STEPS} SELECT DISTINCT a AS src, b AS dst FROM step")
def between_graph(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return paths.between(g, _found(g)).edges


@query(f"""WITH RECURSIVE {STRONG}, {SEEDS},
walk(seed, id, hops) AS (SELECT id, id, 0 FROM s UNION SELECT seed, v, hops + 1 FROM walk JOIN adj ON u = walk.id WHERE hops < 12)
SELECT seed, id, min(hops)::INT AS hops FROM walk GROUP BY ALL""")
def bfs_levels(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return traversal.levels(g, _seeds(g))


@query(f"""WITH RECURSIVE {STRONG}, r(id, root) AS (SELECT u, u FROM deg UNION SELECT v, root FROM r JOIN adj ON u = r.id)
SELECT id, min(root) AS component FROM r GROUP BY id""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.components(_strong(spark, sf))


@query(f"""WITH RECURSIVE {TRADE}, big AS (SELECT * FROM trade WHERE src <> dst AND w > (SELECT quantile_disc(w, 0.9) FROM trade)), ids AS (SELECT src AS id FROM big UNION SELECT dst FROM big),
r(a, b) AS (SELECT id, id FROM ids UNION SELECT a, dst FROM r JOIN big ON src = b)
SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    t = derived.trade(spark, sf)
    cut = t.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY w)").alias("cut"))
    big = t.join(F.broadcast(cut), F.col("w") > F.col("cut")).where("src <> dst")  # one row is broadcast
    return traversal.strong_components(Graph(big.select("src", "dst"), None, True))


_DIST = """walk(seed, id, d) USING KEY (seed, id) AS (SELECT id, id, 0.0::DOUBLE FROM s
  UNION SELECT walk.seed, v, min(walk.d + 1.0::DOUBLE / w) FROM walk JOIN adj ON u = walk.id LEFT JOIN recurring.walk r ON r.id = v AND r.seed = walk.seed WHERE r.d IS NULL OR walk.d + 1.0::DOUBLE / w < r.d GROUP BY walk.seed, v)"""


@query(f"WITH RECURSIVE {STRONG}, {SEEDS}, {_DIST} SELECT seed, id, round(d, 9) AS distance FROM walk")
def weighted_distances(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    weighed = Graph(g.edges.withColumn("length", F.lit(1.0) / F.col("w")))
    return traversal.distances(weighed, _seeds(g), "length").select("seed", "id", F.round("distance", 9).alias("distance"))


@query(f"""WITH RECURSIVE {STRONG}, s AS (SELECT min(u) AS id FROM deg), e AS (SELECT u AS t FROM deg ORDER BY u DESC LIMIT 3), {_DIST}
SELECT seed AS src, id AS dst, round(d, 9) AS distance, round(d, 9) AS walked FROM walk JOIN e ON id = t""")
def lightest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The distance, and what the edges of the path found weigh together."""
    g = _strong(spark, sf)
    weighed = Graph(g.edges.select("src", "dst", (F.lit(1.0) / F.col("w")).alias("length")))
    found = paths.path_edges(traversal.shortest_weighted(weighed, _pairs(g), "length").withColumn("hops", F.size("nodes") - 1).withColumnRenamed("distance", "total").withColumn("nodes", F.col("nodes")))
    sums = found.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(weighed.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "length"), ["a", "b"]).groupBy("src", "dst").agg(F.sum("length").alias("walked"))
    far = traversal.distances(weighed, g.ids().agg(F.min("id").alias("id")), "length").select(F.col("seed").alias("src"), F.col("id").alias("dst"), "distance")
    return sums.join(far, ["src", "dst"]).select("src", "dst", F.round("distance", 9).alias("distance"), F.round("walked", 9).alias("walked"))


@query(f"""WITH RECURSIVE {STRONG}, r(id, level) AS (SELECT u, 0 FROM deg UNION SELECT dst, level + 1 FROM r JOIN strong ON src = r.id)
SELECT id, max(level)::INT AS level FROM r GROUP BY id""")
def topological_levels(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.topological_levels(Graph(derived.strong(spark, sf).select("src", "dst"), None, True))


def _core_sql(rounds: int = 24) -> str:
    parts = [f"WITH {STRONG}, c0 AS (SELECT u, d AS c FROM deg)"]
    for k in range(rounds):
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT u, max(least(c, above)) AS c FROM (SELECT a.u, c, count(*) OVER (PARTITION BY a.u ORDER BY c DESC) AS above FROM adj a JOIN c{k} ON c{k}.u = a.v) GROUP BY u)")
    return ", ".join(parts) + f" SELECT u AS id, c::INT AS core FROM c{rounds}"


@query(_core_sql())
def core_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.core_numbers(_strong(spark, sf))


def _rank_ctes(rounds: int = 30) -> str:
    """Rounds of PageRank, and `pr`, the first of which no rank differs from the one before by 1e-6."""
    parts = [f"{STRONG}, n AS (SELECT count(*) AS n FROM deg), r0 AS (SELECT u AS id, 1.0::DOUBLE / n AS r FROM deg, n)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT a.v AS id, 0.15::DOUBLE / max(n) + 0.85::DOUBLE * sum(r / d) AS r FROM adj a JOIN r{k} p ON p.id = a.u JOIN deg ON deg.u = a.u, n GROUP BY a.v)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(1, rounds + 1))
    gaps = " UNION ALL ".join(f"SELECT {k} AS k, max(abs(x.r - y.r)) AS gap FROM r{k} x JOIN r{k - 1} y USING (id)" for k in range(1, rounds + 1))
    return ", ".join(parts) + f", pr AS MATERIALIZED (SELECT id, r FROM ({every}) WHERE k = (SELECT min(k) FROM ({gaps}) WHERE gap < 1e-6))"


@query(f"WITH {_rank_ctes()} SELECT id, round(r, 9) AS rank FROM pr")
def page_rank(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.page_rank(_strong(spark, sf)).select("id", F.round("rank", 9).alias("rank"))


_PATHS_ON = _PATHS.replace(f"{STRONG}, ", "", 1)


@query(f"WITH {_rank_ctes()}, {_PATHS_ON}, score AS (SELECT s, t, nodes, sum(r) AS score FROM (SELECT s, t, nodes, unnest(nodes) AS id FROM walk) JOIN pr USING (id) GROUP BY ALL) {_BEST}")
def page_rank_ranking(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return _best(paths.by_vertices(_found(g), traversal.page_rank(g).select("id", F.col("rank").alias("score"))))


@query(f"""WITH {_rank_ctes()}, m AS (SELECT max(d) AS md, (SELECT max(r) FROM pr) AS mr FROM deg)
SELECT u AS id, d / md AS by_degree, round(r / mr, 9) AS by_rank, round(0.5::DOUBLE * d / md + 0.5::DOUBLE * r / mr, 9) AS combined FROM deg JOIN pr ON id = u, m""")
def vertex_importance(spark: SparkSession, sf: str) -> DataFrame:
    return truth.importance(_strong(spark, sf)).select("id", "by_degree", F.round("by_rank", 9).alias("by_rank"), F.round("combined", 9).alias("combined"))


@query(f"""WITH {_rank_ctes()}, {_PATHS_ON}, m AS (SELECT max(d) AS md, (SELECT max(r) FROM pr) AS mr FROM deg),
imp AS (SELECT id, unnest(['by_degree', 'by_rank', 'combined']) AS method, unnest([d / md, r / mr, 0.5::DOUBLE * d / md + 0.5::DOUBLE * r / mr]) AS x FROM deg JOIN pr ON id = u, m)
SELECT method, s AS src, t AS dst, array_to_string(nodes, '-') AS path, round(avg(x), 9) AS score FROM (SELECT s, t, nodes, unnest(nodes) AS id FROM walk) JOIN imp USING (id) GROUP BY ALL""")
def path_truths(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return truth.all_truths(_found(g), g).select("method", "src", "dst", F.array_join("nodes", "-").alias("path"), F.round("score", 9).alias("score"))


def _labels_sql(rounds: int = 10) -> str:
    parts = [f"WITH {STRONG}, l0 AS (SELECT u AS id, u AS label FROM deg)"]
    for k in range(rounds):
        parts.append(f"c{k} AS (SELECT a.u AS id, l.label, count(*) AS c FROM adj a JOIN l{k} l ON l.id = a.v GROUP BY ALL), l{k + 1} AS MATERIALIZED (SELECT id, first(label ORDER BY c DESC, label) AS label FROM c{k} GROUP BY id)")
    return ", ".join(parts) + f" SELECT id, label FROM l{rounds}"


@query(_labels_sql())
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.label_propagation(_strong(spark, sf))


@query(None)
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    return communities.louvain(_strong(spark, sf))


@query(None)
def leiden(spark: SparkSession, sf: str) -> DataFrame:
    return communities.leiden(_strong(spark, sf))


@query(f"""WITH {STRONG}, {MEMBER}, m AS (SELECT count(*) AS m FROM strong), k AS (SELECT community, sum(d) AS k FROM deg JOIN member ON id = u GROUP BY community)
SELECT (SELECT count(*) FROM strong JOIN member a ON a.id = src JOIN member b ON b.id = dst WHERE a.community = b.community) / m - (SELECT sum(k::DOUBLE * k) FROM k) / (4.0::DOUBLE * m * m) AS modularity FROM m""")
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    return communities.modularity(_strong(spark, sf), _nations(spark, sf))


@query(f"""WITH {STRONG}, {MEMBER}, e AS (SELECT a.community AS ca, b.community AS cb FROM strong JOIN member a ON a.id = src JOIN member b ON b.id = dst),
x AS (SELECT community, count(*) FILTER (WHERE within) AS inside, count(*) FILTER (WHERE NOT within) AS cut FROM (SELECT unnest(list_distinct([ca, cb])) AS community, ca = cb AS within FROM e) GROUP BY 1),
y AS (SELECT community, count(*) AS size FROM member GROUP BY 1),
z AS (SELECT community, size, coalesce(inside, 0) AS inside, coalesce(cut, 0) AS cut, 2 * coalesce(inside, 0) + coalesce(cut, 0) AS volume, (SELECT 2 * count(*) FROM strong) AS total FROM y LEFT JOIN x USING (community))
SELECT community, size, inside, cut, volume, CASE WHEN size > 1 THEN 2.0::DOUBLE * inside / (size * (size - 1)) ELSE 0 END AS density,
  CASE WHEN least(volume, total - volume) > 0 THEN least(1.0::DOUBLE, cut / least(volume, total - volume)) ELSE 0 END AS conductance FROM z""")
def community_quality(spark: SparkSession, sf: str) -> DataFrame:
    return communities.quality(_strong(spark, sf), _nations(spark, sf))


@query(f"WITH {STRONG}, {MEMBER} SELECT avg((a.community = b.community)::INT) AS coverage FROM strong JOIN member a ON a.id = src JOIN member b ON b.id = dst")
def community_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return communities.coverage(_strong(spark, sf), _nations(spark, sf))


@query(f"""WITH {STRONG} SELECT (SELECT count(*) FROM deg) AS vertices, count(*) AS edges, 0::BIGINT AS loops, count(*) AS distinct_pairs, (SELECT min(d) FROM deg) AS min_degree, (SELECT max(d) FROM deg) AS max_degree,
(SELECT count(*) FROM deg WHERE d % 2 = 1) AS odd_degrees, count(*) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1.0::DOUBLE) / 2) AS density, true AS simple, (SELECT min(d) = max(d) FROM deg) AS regular,
count(*) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1.0::DOUBLE) / 2) = 1 AS complete, (SELECT count(*) FROM deg WHERE d % 2 = 1) = 0 AS eulerian_degrees FROM strong""")
def inferred_properties(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.properties(_strong(spark, sf))


@query(f"""WITH RECURSIVE {STRONG}, r(id, root, side) AS (SELECT u, u, 0 FROM deg UNION SELECT v, root, 1 - side FROM r JOIN adj ON u = r.id),
comp AS (SELECT id, min(root) AS component FROM r GROUP BY id), g AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM strong) AS m, (SELECT count(DISTINCT component) FROM comp) AS c),
t AS (SELECT count(*) AS t FROM strong x JOIN strong y ON x.dst = y.src JOIN strong z ON z.src = x.src AND z.dst = y.dst)
SELECT n AS vertices, m AS edges, c AS components, c <= 1 AS connected, m = n - c AS forest, m = n - c AND c = 1 AS tree, NOT EXISTS (SELECT 1 FROM r WHERE id = root AND side = 1) AS bipartite, t AS triangles FROM g, t""")
def inferred_structure(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.structure(_strong(spark, sf))


@query(f"""WITH {STRONG}, {MEMBER}, m AS (SELECT count(*)::DOUBLE AS m FROM strong), k AS (SELECT community, sum(d) AS k FROM deg JOIN member ON id = u GROUP BY community),
i AS (SELECT a.community, count(*) AS inside FROM strong JOIN member a ON a.id = src JOIN member b ON b.id = dst WHERE a.community = b.community GROUP BY 1)
SELECT community, coalesce(inside, 0) / m - coalesce(k, 0)::DOUBLE * coalesce(k, 0) / (4 * m * m) AS modularity FROM (SELECT DISTINCT community FROM member) LEFT JOIN k USING (community) LEFT JOIN i USING (community), m""")
def community_shares(spark: SparkSession, sf: str) -> DataFrame:
    return communities.community_modularity(_strong(spark, sf), _nations(spark, sf))


@query(f"""WITH {STRONG}, {MEMBER}, e AS (SELECT a.community AS ca, b.community AS cb FROM strong JOIN member a ON a.id = src JOIN member b ON b.id = dst), m AS (SELECT count(*)::DOUBLE AS m FROM strong),
x AS (SELECT community, count(*) FILTER (WHERE within) AS inside, count(*) FILTER (WHERE NOT within) AS cut FROM (SELECT unnest(list_distinct([ca, cb])) AS community, ca = cb AS within FROM e) GROUP BY 1),
y AS (SELECT community, count(*) AS size FROM member GROUP BY 1),
z AS (SELECT size, coalesce(inside, 0) AS inside, coalesce(cut, 0) AS cut, 2 * coalesce(inside, 0) + coalesce(cut, 0) AS volume, 2 * m AS total, m FROM y LEFT JOIN x USING (community), m),
q AS (SELECT *, CASE WHEN size > 1 THEN 2.0::DOUBLE * inside / (size * (size - 1)) ELSE 0 END AS density, CASE WHEN least(volume, total - volume) > 0 THEN least(1.0::DOUBLE, cut / least(volume, total - volume)) ELSE 0 END AS conductance FROM z)
SELECT count(*) AS communities, round(avg(conductance), 9) AS conductance, round(sum(conductance * size) / sum(size), 9) AS weighted_conductance, round(avg(density), 9) AS density,
round(sum(inside) / max(m) - sum(volume * volume) / (4 * max(m) * max(m)), 9) AS modularity, round((SELECT avg((ca = cb)::INT) FROM e), 9) AS coverage FROM q""")
def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    row = communities.summary(_strong(spark, sf), _nations(spark, sf))
    return row.select("communities", *(F.round(c, 9).alias(c) for c in row.columns if c != "communities"))


@query("""WITH e AS (SELECT vec_id AS src, vec_id + 1 AS dst FROM embeddings), x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT src, dst, round(coalesce(abs(corr(a.v, b.v)), 0) + 1e-10, 6) AS mi FROM e LEFT JOIN x a ON a.vec_id = src LEFT JOIN x b ON b.vec_id = dst AND b.i = a.i GROUP BY src, dst""")
def attribute_similarity(spark: SparkSession, sf: str) -> DataFrame:
    v = derived.table(spark, sf, "embeddings")
    out = information.attribute_similarity(v.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")))
    return out.select("src", "dst", F.round("mi", 6).alias("mi"))


@query(f"""WITH {TRADE} SELECT src, dst, exp(-0.001::DOUBLE * greatest(0, 500 - w)) * CASE WHEN w % 2 = 1 THEN 0.5 ELSE 1 END * least(1, w / 100.0::DOUBLE) * CASE WHEN src % 5 = dst % 5 THEN 1.5 ELSE 1 END AS mi FROM trade""")
def edge_attribute_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("w")
    mi = information.decayed(F.lit(1.0), w, F.lit(500))
    mi = information.modified(mi, F.when(w % 2 == 1, -1).otherwise(1), w / 100.0, F.col("src") % 5 == F.col("dst") % 5)
    return derived.trade(spark, sf).select("src", "dst", mi.alias("mi"))


@query(f"""WITH {STRONG}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM strong x JOIN strong y ON x.dst = y.src JOIN strong z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT id, count(*) AS k FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id), cc AS (SELECT u, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(k, 0) / (d * (d - 1)) ELSE 0 END AS c FROM deg LEFT JOIN n ON n.id = u)
SELECT src, dst, 1 - greatest(x.c, y.c) + 1e-10 AS penalty FROM strong JOIN cc x ON x.u = src JOIN cc y ON y.u = dst""")
def clustering_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return information.clustering_penalty(_strong(spark, sf))


@query(f"""WITH {STRONG}, o AS (SELECT a.u AS c, a.v AS x, b.v AS y FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v ANTI JOIN strong s ON s.src = a.v AND s.dst = b.v),
claw AS (SELECT count(*) AS n FROM o p JOIN o q ON p.c = q.c AND p.x = q.x AND p.y < q.y JOIN o r ON r.c = p.c AND r.x = p.y AND r.y = q.y),
diamond AS (SELECT count(*) AS n FROM strong e JOIN adj a ON a.u = e.src JOIN adj b ON b.u = e.dst AND b.v = a.v JOIN adj c ON c.u = e.src JOIN adj d ON d.u = e.dst AND d.v = c.v WHERE a.v < c.v AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.src = a.v AND s.dst = c.v))
SELECT 'P3' AS pattern, (SELECT count(*) FROM o) AS copies UNION ALL SELECT 'claw', n FROM claw UNION ALL SELECT 'diamond', n FROM diamond""")
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return classes.pattern_counts(_strong(spark, sf), ["P3", "claw", "diamond"])


@query(None)
def vertex_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.biconnected(_strong(spark, sf)).select("src", "dst", "block")


def _levels_sql(rounds: int = 8) -> str:
    """dist: hops and number of shortest paths between all pairs, level by level."""
    parts = ["l0 AS (SELECT u AS s, u AS id, 1.0::DOUBLE AS sigma FROM deg)", "seen0 AS (SELECT s, id FROM l0)"]
    for k in range(1, rounds + 1):
        parts.append(f"l{k} AS MATERIALIZED (SELECT s, v AS id, sum(sigma) AS sigma FROM l{k - 1} JOIN adj ON u = l{k - 1}.id ANTI JOIN seen{k - 1} o ON o.s = l{k - 1}.s AND o.id = adj.v GROUP BY ALL), seen{k} AS MATERIALIZED (SELECT * FROM seen{k - 1} UNION ALL SELECT s, id FROM l{k})")
    return ", ".join(parts) + ", dist AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, id, {k} AS hops, sigma FROM l{k}" for k in range(rounds + 1)) + ")"


_BETWEEN = f"{_levels_sql()}, bt AS (SELECT x.id, sum(x.sigma * y.sigma / z.sigma) AS b FROM dist z JOIN dist x ON x.s = z.s JOIN dist y ON y.s = x.id AND y.id = z.id WHERE x.hops + y.hops = z.hops AND x.id <> z.s AND x.id <> z.id GROUP BY x.id)"


@query(f"WITH {STRONG}, {_BETWEEN} SELECT u AS id, round(coalesce(b, 0), 6) AS betweenness FROM deg LEFT JOIN bt ON id = u")
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return expansion.betweenness(g, g.ids()).select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"WITH {_PATHS}, {_BETWEEN}, score AS (SELECT s, t, nodes, sum(coalesce(b, 0)) AS score FROM (SELECT s, t, nodes, unnest(nodes) AS id FROM walk) LEFT JOIN bt USING (id) GROUP BY ALL) {_BEST.replace('9)', '6)')}")
def betweenness_ranking(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    best = paths.top_paths(paths.by_vertices(_found(g), expansion.betweenness(g, g.ids()).withColumnRenamed("betweenness", "score")), 5, F.round("score", 6))
    return best.select("src", "dst", F.array_join("nodes", "-").alias("path"), "position", F.round("score", 6).alias("score"))


@query(f"WITH {STRONG}, {_levels_sql()} SELECT max(e)::INT AS diameter, min(e)::INT AS radius, (SELECT round(avg(hops), 9) FROM dist WHERE s <> id) AS mean_distance FROM (SELECT s, max(hops) AS e FROM dist GROUP BY s)")
def graph_distances(spark: SparkSession, sf: str) -> DataFrame:
    return classes.distances_row(_strong(spark, sf)).select("diameter", "radius", F.round("mean_distance", 9).alias("mean_distance"))


def _two_seeds(g: Graph) -> DataFrame:
    """Three queries of two seeds each."""
    return _pairs(g).select(F.col("dst").alias("query"), F.explode(F.array("src", "dst")).alias("seed"))


_PAIR_SEEDS = "e AS (SELECT (SELECT min(u) FROM deg) AS s, u AS t FROM deg ORDER BY u DESC LIMIT 3), q AS (SELECT t AS query, unnest([s, t]) AS seed FROM e)"


def _digits(x: str) -> str:
    """SQL of the whole part of log2(x + 1)."""
    return f"(length(bin(floor(greatest({x}, 0))::BIGINT + 1)) - 1)"


#: Bands of the orders, over the open rows o with what _band_parts adds.
_BANDS = {
    "breadth_first": "depth", "degree": _digits("degree"), "high_degree": f"-{_digits('degree')}", "frontier_balanced": "size", "random": "('0x' || left(md5(id::VARCHAR), 7))::INT % 8",
    "degree_surprise": f"-{_digits('round(spread, 9)')}", "entropy_guided": _digits("round(10 * ln(degree + 1) / (entropy + 0.001::DOUBLE), 9)"), "salience": f"-{_digits('round(1000 * (degree / 100.0::DOUBLE), 9)')}",
    "cross_seed": _digits("(degree + 1) * (1 + owners)"), "path_preserving": _digits("degree / (1 + potential)"),
}


def _expansion_ctes(order: str, rounds: int = 45, stop: str = "false") -> str:
    """`owned` after rounds in which each query expands all its open vertices of the lowest band; stop: over owned rows x of a query."""
    parts = [f"""{STRONG}, {_PAIR_SEEDS}, kinds AS (SELECT u, w % 3 AS kind, count(*) AS c FROM adj GROUP BY ALL),
ent AS (SELECT u, -sum(c / d * log2(c / d)) AS entropy FROM kinds JOIN deg USING (u) GROUP BY u), sp AS (SELECT a.u, avg(x.d) AS mean, stddev_pop(x.d) AS sd FROM adj a JOIN deg x ON x.u = a.v GROUP BY a.u),
facts AS MATERIALIZED (SELECT u AS id, d AS degree, CASE WHEN sd > 0 THEN abs(d - mean) / sd ELSE abs(d - mean) END AS spread, entropy FROM deg JOIN sp USING (u) JOIN ent USING (u)),
o0 AS MATERIALIZED (SELECT query, seed, seed AS id, NULL::BIGINT AS parent, 0 AS depth, 0 AS round, false AS done FROM q)"""]
    extra, join = "", ""
    if order == "frontier_balanced":
        extra, join = ", count(*) OVER (PARTITION BY query, seed) AS size", ""
    for k in range(rounds):
        o = f"o{k}"
        if order == "cross_seed":
            extra, join = ", owners", f"JOIN (SELECT query, id, count(DISTINCT seed) AS owners FROM {o} GROUP BY ALL) USING (query, id)"
        elif order == "path_preserving":
            extra, join = ", coalesce(potential, 0) AS potential", f"LEFT JOIN (SELECT w.query, w.seed, w.id, count(DISTINCT a.v) AS potential FROM {o} w JOIN adj a ON a.u = w.id JOIN {o} x ON x.query = w.query AND x.id = a.v AND x.seed <> w.seed WHERE NOT w.done GROUP BY ALL) USING (query, seed, id)"
        parts.append(f"b{k} AS MATERIALIZED (SELECT query, seed, id, depth, {_BANDS[order]} AS band FROM (SELECT w.*, degree, spread, entropy{extra} FROM (SELECT * FROM {o} WHERE NOT done) w JOIN facts USING (id) {join}))")
        parts.append(f"p{k} AS MATERIALIZED (SELECT * FROM b{k} WHERE band = (SELECT min(band) FROM b{k} y WHERE y.query = b{k}.query))")
        parts.append(f"f{k} AS (SELECT query, seed, v AS id, min({{'depth': depth + 1, 'parent': u}}) AS p FROM p{k} JOIN adj ON u = p{k}.id ANTI JOIN {o} z ON z.query = p{k}.query AND z.seed = p{k}.seed AND z.id = adj.v GROUP BY ALL)")
        parts.append(f"n{k} AS MATERIALIZED (SELECT {o}.*, p{k}.band IS NOT NULL AS now FROM {o} LEFT JOIN p{k} USING (query, seed, id))")
        parts.append(f"g{k} AS (SELECT query, seed, id, parent, o.depth, round, done OR now AS done FROM n{k} o UNION ALL SELECT query, seed, id, p.parent, p.depth, {k + 1}, false FROM f{k})")
        parts.append(f"o{k + 1} AS MATERIALIZED (SELECT query, seed, id, parent, depth, round, done OR query IN (SELECT query FROM g{k} x GROUP BY query HAVING {stop}) AS done FROM g{k})")
    return ", ".join(parts) + f", owned AS (SELECT query, seed, id, parent, depth, round FROM o{rounds})"


def _grown(spark: SparkSession, sf: str, order: str, stop: str | None = None) -> DataFrame:
    g = _strong(spark, sf)
    g = Graph(g.edges.withColumn("type", F.col("w") % 3))
    scores = g.degrees().select("id", (F.col("degree") / 100.0).alias("score")) if order == "salience" else None
    return expansion.expand(g, _two_seeds(g), order, stop, scores=scores)


def _expansion(order: str, stop: str | None = None):
    """Every vertex that a seed comes to own, with its parent, depth and round."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _grown(spark, sf, order, stop)

    run.__name__ = f"expansion_{order}"
    return run


for _order in expansion.ORDERS:
    query(f"WITH {_expansion_ctes(_order)} SELECT * FROM owned" if _order in _BANDS else None)(_expansion(_order))


@query(f"WITH {_expansion_ctes('entropy_guided', 30, 'count(*) > count(DISTINCT id)')} SELECT * FROM owned")
def heterogeneity_aware(spark: SparkSession, sf: str) -> DataFrame:
    """The entropy-guided order until shared vertices connect the seeds."""
    return _grown(spark, sf, "entropy_guided", "connected")


@query(f"WITH {_expansion_ctes('degree', 30, 'count(DISTINCT id) >= 0.8 * (SELECT count(*) FROM deg)')} SELECT * FROM owned")
def expansion_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _grown(spark, sf, "degree", "coverage")


@query(f"WITH {_expansion_ctes('high_degree', 30, 'count(*) > count(DISTINCT id)')} SELECT * FROM owned")
def expansion_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return _grown(spark, sf, "high_degree", "pairwise")


@query(f"WITH {_expansion_ctes('degree', 30, 'count(*) > count(DISTINCT id)')} SELECT a.query, a.id, array_to_string([least(a.seed, b.seed), greatest(a.seed, b.seed)], '-') AS seeds FROM owned a JOIN owned b ON a.query = b.query AND a.id = b.id AND a.seed < b.seed")
def expansion_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Where the two seeds of a query meet first."""
    return expansion.meetings(_grown(spark, sf, "degree", "common")).select("query", "id", F.array_join("seeds", "-").alias("seeds"))


_MET = f"WITH {_expansion_ctes('degree', 30, 'count(DISTINCT id) >= 0.5 * (SELECT count(*) FROM deg)')}"


def _half(spark: SparkSession, sf: str) -> DataFrame:
    """Owned rows when the seeds of a query own half of all vertices."""
    g = _strong(spark, sf)
    return expansion.expand(g, _two_seeds(g), "degree", "coverage", share=0.5)


@query(f"{_MET} SELECT a.query, a.seed AS a, b.seed AS b, count(*) AS shared FROM owned a JOIN owned b ON a.query = b.query AND a.id = b.id AND a.seed < b.seed GROUP BY ALL")
def seed_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return expansion.overlaps(_half(spark, sf))


@query(f"{_MET}, r AS (SELECT query, seed, max(depth) AS radius FROM owned GROUP BY ALL), z AS (SELECT * FROM owned JOIN r USING (query, seed)) SELECT a.query, a.seed AS a, b.seed AS b, count(*) AS shared FROM z a JOIN z b ON a.query = b.query AND a.id = b.id AND a.seed < b.seed WHERE (a.depth <= b.radius OR b.depth <= a.radius) AND a.depth <= 2 AND b.depth <= 2 GROUP BY ALL")
def sphere_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return expansion.sphere_overlaps(_half(spark, sf), 2)


@query(f"{_MET}, k AS (SELECT query, seed, count(*) AS k FROM owned GROUP BY ALL), s AS (SELECT a.query, a.seed AS a, b.seed AS b, count(*) AS shared FROM owned a JOIN owned b ON a.query = b.query AND a.id = b.id AND a.seed < b.seed GROUP BY ALL) SELECT s.query, a, b, shared / (x.k + y.k - shared) AS similarity FROM s JOIN k x ON x.query = s.query AND x.seed = a JOIN k y ON y.query = s.query AND y.seed = b WHERE shared / (x.k + y.k - shared) >= 0.1")
def threshold_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return expansion.threshold_overlaps(_half(spark, sf), 0.1)


@query(f"WITH {_PATHS} SELECT t AS query, s AS src, t AS dst, min(len(nodes))::INT - 1 AS hops FROM walk GROUP BY ALL")
def bidirectional_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hops of the shortest way that two breadth-first searches find when they meet."""
    g = _strong(spark, sf)
    owned = expansion.expand(g, _two_seeds(g), "breadth_first", stop="common")
    return expansion.meeting_paths(owned).groupBy("query", "src", "dst").agg((F.min(F.size("nodes")) - 1).alias("hops"))
