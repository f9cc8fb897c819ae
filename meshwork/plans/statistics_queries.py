"""Queries over samples, distributions and rankings taken from the tables, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions import statistics
from meshwork.graph import Graph
from meshwork.operators import information, paths, truth
from meshwork.plans.graph_queries import _PATHS, _STEPS, COMMON, COSUPP, STRONG, _found, _pairs, _strong
from meshwork.sources import derived

QUERIES: dict = {}
SQL: dict[str, str] = {}

CDF = "(CASE WHEN {x} < 0 THEN 0.5 * (1 - {e}) WHEN {x} = 0 THEN 0.5 ELSE 0.5 * (1 + {e}) END)"


def _cdf(x: str) -> str:
    z = f"(abs({x}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z}))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    return CDF.format(x=f"({x})", e=f"(1 - {poly} * exp(-{z} * {z}))")


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of orders by priority."""
    return derived.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("value"))


_PAIR = "p AS (SELECT min(o_orderpriority) AS a, max(o_orderpriority) AS b FROM orders)"


def _pair(samples: DataFrame) -> tuple[str, str]:
    r = samples.agg(F.min("method"), F.max("method")).first()
    return r[0], r[1]


@query(f"""WITH {_PAIR}, g AS (SELECT count(*) FILTER (WHERE o_orderpriority = a) AS na, count(*) FILTER (WHERE o_orderpriority = b) AS nb, avg(o_totalprice) FILTER (WHERE o_orderpriority = a) AS ma, avg(o_totalprice) FILTER (WHERE o_orderpriority = b) AS mb,
var_samp(o_totalprice) FILTER (WHERE o_orderpriority = a) AS va, var_samp(o_totalprice) FILTER (WHERE o_orderpriority = b) AS vb FROM orders, p)
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 9) AS cohens_d, round((ma - mb) / sqrt(vb), 9) AS glass_delta FROM g""")
def effect_sizes(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    return statistics.effect_sizes(s, *_pair(s)).select(F.round("cohens_d", 9).alias("cohens_d"), F.round("glass_delta", 9).alias("glass_delta"))


_U = f"""WITH {_PAIR}, s AS (SELECT o_orderpriority AS m, o_totalprice AS v FROM orders, p WHERE o_orderpriority IN (a, b)),
r AS (SELECT m, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM s),
g AS (SELECT count(*) FILTER (WHERE m = a)::DOUBLE AS n1, count(*) FILTER (WHERE m = b)::DOUBLE AS n2, sum(r) FILTER (WHERE m = a) AS r1 FROM r, p),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1 FROM g), z AS (SELECT n1, n2, u1, least(u1, n1 * n2 - u1) AS u FROM u),
y AS (SELECT *, -abs((u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)) AS x FROM z)
SELECT round(2 * u1 / (n1 * n2) - 1, 9) AS cliffs_delta, u, round(2 * {_cdf('x')}, 9) AS p FROM y"""


@query(_U)
def rank_tests(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    return statistics.cliffs_delta(s, *_pair(s)).select(F.round("cliffs_delta", 9).alias("cliffs_delta"), "u", F.round("p", 9).alias("p"))


@query(f"""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem), g AS (SELECT avg(d) AS mean, stddev_samp(d) AS sd, count(*) AS n FROM d), t AS (SELECT mean, mean / (sd / sqrt(n)) AS t FROM g)
SELECT round(mean, 9) AS mean, round(t, 6) AS t, round(2 * (1 - {_cdf('abs(t)')}), 9) AS p FROM t""")
def paired_test(spark: SparkSession, sf: str) -> DataFrame:
    s = derived.table(spark, sf, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return statistics.paired(s).select(F.round("mean", 9).alias("mean"), F.round("t", 6).alias("t"), F.round("p", 9).alias("p"))


_TESTS = "tests AS (SELECT n_name AS test, ((n_nationkey * 7919) % 1000 + 1) / 20000.0::DOUBLE AS p FROM nation)"


@query(f"""WITH {_TESTS}, pi AS (SELECT least(1.0, count(*) FILTER (WHERE p > 0.5) / count(*) / 0.5) AS pi0 FROM tests), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS i FROM tests, pi)
SELECT test, p, least(1.0, p * m) AS bonferroni, max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i) AS holm, min(least(1.0, p * m / i)) OVER (ORDER BY i DESC) AS benjamini_hochberg, max(least(1.0, p * m * pi0 / i)) OVER (ORDER BY i DESC) AS storey, p < 0.05::DOUBLE / m AS significant FROM r""")
def multiple_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    p = (F.pmod(F.col("n_nationkey").cast("long") * 7919, F.lit(1000)) + 1) / 20000.0
    return statistics.corrected(derived.table(spark, sf, "nation").select(F.col("n_name").alias("test"), p.alias("p")))


_LARGE = "large AS (SELECT n_name AS test, ((n_nationkey * 7919) % 1000 + 1) / 1100.0::DOUBLE AS p FROM nation)"


@query(f"""WITH {_LARGE}, pi AS (SELECT least(1.0, count(*) FILTER (WHERE p > 0.5) / count(*) / 0.5) AS pi0 FROM large), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS i FROM large, pi)
SELECT test, min(least(1.0, p * m * pi0 / i)) OVER (ORDER BY i DESC) AS q FROM r""")
def storey_q_values(spark: SparkSession, sf: str) -> DataFrame:
    p = (F.pmod(F.col("n_nationkey").cast("long") * 7919, F.lit(1000)) + 1) / 1100.0
    return statistics.corrected(derived.table(spark, sf, "nation").select(F.col("n_name").alias("test"), p.alias("p")), monotone="min").select("test", F.col("storey").alias("q"))


@query(f"""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d),
g AS (SELECT count(*)::DOUBLE AS n, sum(r) FILTER (WHERE d > 0) AS plus FROM r), w AS (SELECT n, least(plus, n * (n + 1) / 2 - plus) AS w FROM g), z AS (SELECT *, abs((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)) AS z FROM w)
SELECT w, round(2 * (1 - {_cdf('z')}), 9) AS p FROM z""")
def signed_rank_test(spark: SparkSession, sf: str) -> DataFrame:
    s = derived.table(spark, sf, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return statistics.wilcoxon(s).select("w", F.round("p", 9).alias("p"))


@query(_U.replace("SELECT round(2 * u1 / (n1 * n2) - 1, 9) AS cliffs_delta, u, ", "SELECT round(2 * u1 / (n1 * n2) - 1, 9) AS correlation, CASE WHEN abs(2 * u1 / (n1 * n2) - 1) < 0.147 THEN 'negligible' WHEN abs(2 * u1 / (n1 * n2) - 1) < 0.33 THEN 'small' WHEN abs(2 * u1 / (n1 * n2) - 1) < 0.474 THEN 'medium' ELSE 'large' END AS interpretation FROM y -- ").split(" -- ")[0])
def rank_biserial(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    return statistics.rank_biserial(s, *_pair(s)).select(F.round("correlation", 9).alias("correlation"), "interpretation")


@query("SELECT o_orderpriority AS method, round(avg(o_totalprice), 6) AS mean, round(avg(o_totalprice) - 1.96::DOUBLE * stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS low, round(avg(o_totalprice) + 1.96::DOUBLE * stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS high FROM orders GROUP BY 1")
def confidence_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.confidence_interval(_samples(spark, sf)).select("method", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


_DRAW = "(('0x' || left(md5('42:' || id || ':' || r), 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _poisson_sql() -> str:
    below, term, cases = 0.0, math.exp(-1), []
    for k in range(1, 11):
        below += term
        cases.append(f"WHEN u >= {below!r}::DOUBLE THEN {k}")
        term /= k
    return "CASE " + " ".join(reversed(cases)) + " ELSE 0 END"


_BOOT = f"""c AS (SELECT c_custkey AS id, c_mktsegment AS method, c_acctbal AS value FROM customer), u AS (SELECT *, {_DRAW} AS u FROM c, range(1, 201) t(r)), w AS (SELECT *, {_poisson_sql()} AS w FROM u)"""


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("method"), F.col("c_acctbal").alias("value"))


@query(f"""WITH {_BOOT}, m AS (SELECT method, r, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL)
SELECT method, round((SELECT avg(value) FROM c WHERE c.method = m.method), 6) AS mean, round(quantile_disc(m, 0.025), 6) AS low, round(quantile_disc(m, 0.975), 6) AS high FROM m GROUP BY method""")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = statistics.bootstrap(_customers(spark, sf), 200)
    return out.select("method", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {_BOOT}, e AS (SELECT min(method) AS a, max(method) AS b FROM c), d AS (SELECT r, sum(w * value) FILTER (WHERE method = a) / sum(w) FILTER (WHERE method = a) - sum(w * value) FILTER (WHERE method = b) / sum(w) FILTER (WHERE method = b) AS d FROM w, e GROUP BY r)
SELECT round((SELECT avg(value) FILTER (WHERE method = a) - avg(value) FILTER (WHERE method = b) FROM c, e), 6) AS difference, round(quantile_disc(d, 0.025), 6) AS low, round(quantile_disc(d, 0.975), 6) AS high, round(2 * least(avg((d > 0)::INT), 1 - avg((d > 0)::INT)), 6) AS p FROM d""")
def bootstrap_difference(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf)
    out = statistics.bootstrap_difference(c, *_pair(c), 200)
    return out.select(*(F.round(x, 6).alias(x) for x in ("difference", "low", "high", "p")))


_DIST = f"""{STRONG}, cadj AS (SELECT src AS u FROM cosupp UNION ALL SELECT dst FROM cosupp), cdeg AS (SELECT u, count(*) AS d FROM cadj GROUP BY u),
p AS (SELECT d AS bin, count(*) / (SELECT count(*) FROM cdeg) AS p FROM cdeg GROUP BY d), q AS (SELECT d AS bin, count(*) / (SELECT count(*) FROM deg) AS q FROM deg GROUP BY d),
b AS (SELECT coalesce(p.bin, q.bin) AS bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q ON p.bin = q.bin)"""


def degree_shares(g: Graph) -> DataFrame:
    d = g.degrees()
    total = d.agg(F.count("*").alias("t"))
    return d.groupBy(F.col("degree").alias("bin")).agg(F.count("*").alias("c")).join(F.broadcast(total)).select("bin", (F.col("c") / F.col("t")).alias("share"))  # one row is broadcast


@query(f"WITH {STRONG} SELECT d AS bin, count(*) / (SELECT count(*) FROM deg) AS share FROM deg GROUP BY d")
def degree_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return degree_shares(Graph(derived.strong(spark, sf)))


@query(f"""WITH {_DIST}, w AS (SELECT *, abs(sum(p - q) OVER (ORDER BY bin)) AS gap, (p + q) / 2 AS m FROM b)
SELECT round(greatest(0, sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10)))), 9) AS kl, round(0.5 * sum((p + 1e-10) * ln((p + 1e-10) / (m + 1e-10))) + 0.5 * sum((q + 1e-10) * ln((q + 1e-10) / (m + 1e-10))), 9) AS js, round(sum(gap), 9) AS emd FROM w""")
def distribution_distances(spark: SparkSession, sf: str) -> DataFrame:
    d = statistics.divergences(degree_shares(Graph(derived.cosupp(spark, sf))), degree_shares(Graph(derived.strong(spark, sf))))
    return d.select(*(F.round(c, 9).alias(c) for c in d.columns))


@query(f"WITH {STRONG} SELECT CASE {' '.join(f'WHEN d <= {k} THEN {chr(39)}{n}{chr(39)}' for k, n in statistics.DEGREE_CLASSES)} ELSE '{statistics.LAST_CLASS}' END AS bucket, count(*) AS n FROM deg GROUP BY 1")
def degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(derived.strong(spark, sf)).degrees().groupBy(statistics.degree_class(F.col("degree")).alias("bucket")).agg(F.count("*").alias("n"))


_CLASS = f"CASE {' '.join(f'WHEN d <= {k} THEN {i}' for i, (k, _) in enumerate(statistics.DEGREE_CLASSES))} ELSE 6 END"


@query(f"""WITH {STRONG}, cdeg AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM cosupp UNION ALL SELECT dst FROM cosupp) GROUP BY u), b AS (SELECT i FROM range(0, 7) t(i)),
x AS (SELECT i, ((SELECT count(*) FROM cdeg WHERE {_CLASS} = i) + 1) / ((SELECT count(*) FROM cdeg) + 7.0::DOUBLE) AS p, ((SELECT count(*) FROM deg WHERE {_CLASS} = i) + 1) / ((SELECT count(*) FROM deg) + 7.0::DOUBLE) AS q FROM b)
SELECT round(sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2, 9) AS jsd FROM x""")
def degree_class_divergence(spark: SparkSession, sf: str) -> DataFrame:
    p, q = (Graph(x).degrees().select("degree") for x in (derived.cosupp(spark, sf), derived.strong(spark, sf)))
    return statistics.class_divergence(p, q).select(F.round("jsd", 9).alias("jsd"))


def _sample(g: Graph) -> DataFrame:
    """Every other vertex, as a sample of the graph's vertices."""
    return g.ids().where("id % 2 = 0")


_SAMPLED = "sam AS (SELECT u AS id FROM deg WHERE u % 2 = 0), tru AS (SELECT u AS id FROM deg WHERE u % 3 < 2)"


@query(f"""WITH {STRONG}, {_SAMPLED}, n AS (SELECT count(*) FILTER (WHERE s.id IS NOT NULL AND t.id IS NOT NULL) AS b, count(*) FILTER (WHERE t.id IS NULL) AS os, count(*) FILTER (WHERE s.id IS NULL) AS ot FROM sam s FULL JOIN tru t ON s.id = t.id)
SELECT b AS both, os AS only_sample, ot AS only_truth, b / (b + ot) AS coverage, b / (b + os) AS precision, round(2 * (b / (b + ot)) * (b / (b + os)) / (b / (b + ot) + b / (b + os)), 9) AS f1 FROM n""")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(derived.strong(spark, sf)).stored()
    return statistics.set_overlap(_sample(g), g.ids().where("id % 3 < 2")).withColumn("f1", F.round("f1", 9))


@query(f"""WITH {STRONG}, {_SAMPLED}, sd AS (SELECT u AS id, d FROM deg WHERE u % 2 = 0), td AS (SELECT u AS id, d FROM deg WHERE u % 3 < 2),
n AS (SELECT count(*) FILTER (WHERE s.id IS NOT NULL AND t.id IS NOT NULL) AS b, count(*) FILTER (WHERE t.id IS NULL) AS os, count(*) FILTER (WHERE s.id IS NULL) AS ot FROM sam s FULL JOIN tru t ON s.id = t.id),
p AS (SELECT d AS bin, count(*) / (SELECT count(*) FROM td) AS p FROM td GROUP BY d), q AS (SELECT d AS bin, count(*) / (SELECT count(*) FROM sd) AS q FROM sd GROUP BY d),
b AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q ON p.bin = q.bin),
k AS (SELECT round(greatest(0, sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10)))), 9) AS kl, round(0.5 * sum((p + 1e-10) * ln((p + 1e-10) / (m + 1e-10))) + 0.5 * sum((q + 1e-10) * ln((q + 1e-10) / (m + 1e-10))), 9) AS js FROM b),
ra AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS a FROM sd), rb AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS b FROM td),
c AS (SELECT CASE WHEN count(*) > 1 THEN round(1 - 6 * sum((a - b) * (a - b)) / (count(*)::DOUBLE * count(*) * count(*) - count(*)), 9) ELSE 0 END AS r FROM ra JOIN rb USING (id)),
h AS (SELECT count(DISTINCT s_nationkey) / (SELECT count(DISTINCT s_nationkey) FROM supplier) AS h FROM supplier JOIN sam ON id = s_suppkey)
SELECT b AS both, os AS only_sample, ot AS only_truth, b / (b + ot) AS coverage, b / (b + os) AS precision, round(2 * (b / (b + ot)) * (b / (b + os)) / (b / (b + ot) + b / (b + os)), 9) AS f1, kl AS degree_kl, js AS degree_js, r AS degree_rank_correlation, h AS community_coverage FROM n, k, c, h""")
def representativeness(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(derived.strong(spark, sf)).stored()
    d = g.degrees().select("id", "degree")
    out = statistics.representativeness(d.where("id % 2 = 0"), d.where("id % 3 < 2"), derived.suppliers(spark, sf).withColumnRenamed("nation", "community"))
    return out.select(*(F.round(c, 9).alias(c) if c in ("f1", "degree_kl", "degree_js", "degree_rank_correlation") else c for c in out.columns))


@query(f"WITH {STRONG}, r AS (SELECT u, row_number() OVER (ORDER BY d DESC, u) AS i FROM deg) SELECT u AS id FROM r WHERE i <= greatest(1, ceil((SELECT count(*) FROM deg) * 0.1::DOUBLE))")
def hub_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.hubs(Graph(derived.strong(spark, sf)).stored().degrees())


_RUNS = "runs AS (SELECT s_nationkey % 4 AS run, d AS degree FROM deg JOIN supplier ON u = s_suppkey), l AS (SELECT run, degree, CASE WHEN degree <= 5 THEN 1 WHEN degree <= 10 THEN 6 WHEN degree <= 50 THEN 11 ELSE 51 END AS low FROM runs), h AS (SELECT run, count(*) AS expanded, count(*) FILTER (WHERE low >= 11) AS hubs, count(*) FILTER (WHERE low < 11 AND low <= 5) AS peripheral FROM l GROUP BY run), r AS (SELECT *, hubs / expanded AS hub_rate, CASE WHEN hubs > 0 THEN peripheral / hubs ELSE peripheral END AS peripheral_ratio FROM h)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    d = Graph(derived.strong(spark, sf)).degrees()
    return d.join(derived.suppliers(spark, sf), "id").select((F.col("nation") % 4).alias("run"), "degree")


@query(f"WITH {STRONG}, {_RUNS} SELECT run, expanded, hubs, peripheral, hub_rate, peripheral_ratio FROM r")
def hub_avoidance(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.hub_avoidance(_runs(spark, sf), 11, 5)


@query(f"WITH {STRONG}, {_RUNS} SELECT count(*) AS runs, round(avg(hub_rate), 9) AS hub_rate, round(avg(peripheral_ratio), 9) AS peripheral_ratio FROM r")
def mean_hub_avoidance(spark: SparkSession, sf: str) -> DataFrame:
    out = statistics.mean_hub_avoidance(_runs(spark, sf), 11, 5)
    return out.select("runs", F.round("hub_rate", 9).alias("hub_rate"), F.round("peripheral_ratio", 9).alias("peripheral_ratio"))


@query(f"WITH {STRONG}, {_RUNS}, d AS (SELECT x.hub_rate - y.hub_rate AS a, x.peripheral_ratio - y.peripheral_ratio AS b FROM r x, r y WHERE x.run = 0 AND y.run = 1) SELECT a AS hub_rate, b AS peripheral_ratio, a < 0 AND b > 0 AS better FROM d")
def compared_hub_avoidance(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.compared_hub_avoidance(statistics.hub_avoidance(_runs(spark, sf), 11, 5), 0, 1)


@query(f"WITH {STRONG} SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE u % 2 = 0) / count(*) ELSE 0 END AS topic_coverage FROM deg WHERE d >= 10")
def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(derived.strong(spark, sf)).stored()
    return statistics.hub_sample_coverage(_sample(g), g.degrees())


@query(f"""WITH {_PATHS}, hub AS (SELECT u FROM (SELECT u, row_number() OVER (ORDER BY d DESC, u) AS i FROM deg) WHERE i <= greatest(1, ceil((SELECT count(*) FROM deg) * 0.1::DOUBLE)))
SELECT s AS src, t AS dst, round(avg(hit), 9) AS hub_coverage FROM (SELECT s, t, nodes, max((u IS NOT NULL)::INT) AS hit FROM (SELECT s, t, nodes, unnest(nodes) AS id FROM walk) LEFT JOIN hub ON u = id GROUP BY ALL) GROUP BY ALL""")
def hub_coverage(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    return statistics.hub_coverage(_found(g), statistics.hubs(g.degrees())).withColumn("hub_coverage", F.round("hub_coverage", 9))


@query(f"""WITH {_PATHS}, {COMMON}, mi AS (SELECT src, dst, common / (ds + dt - common) + 1e-10 AS mi FROM c), {_STEPS},
score AS (SELECT s, t, nodes, exp(avg(ln(mi + 1e-10))) AS score FROM step JOIN mi ON mi.src = a AND mi.dst = b GROUP BY ALL),
best AS (SELECT s, t, nodes FROM score QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY score DESC, len(nodes), nodes) <= 10), short AS (SELECT *, len(nodes) <= 3 AS found FROM walk)
SELECT count(*) FILTER (WHERE found) AS hit, count(*) FILTER (WHERE found) / count(*) AS coverage, coalesce(count(*) FILTER (WHERE found) / nullif((SELECT count(*) FROM short WHERE found), 0), 0) AS precision FROM best JOIN short USING (s, t, nodes)""")
def salience_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each pair's ten best paths of up to three edges are among the paths of up to two."""
    g = _strong(spark, sf)
    mi = information.structural(g).select("src", "dst", F.col("jaccard").alias("mi"))
    best = truth.salience_truth(g, _pairs(g), mi, 10, 3)
    found = _found(g).where("hops <= 2").select(paths.signature(F.col("nodes")).alias("signature"))
    return statistics.path_coverage(found, best)


@query("""WITH r AS (SELECT c_nationkey AS query, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position, (c_mktsegment = 'BUILDING')::INT AS relevance FROM customer),
s AS (SELECT *, sum(relevance) OVER (PARTITION BY query ORDER BY position) AS hits, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, position) AS best FROM r),
g AS (SELECT query, sum(relevance) FILTER (WHERE position <= 10) AS found, sum(relevance) AS relevant, avg(hits / position) FILTER (WHERE relevance > 0) AS ap, min(position) FILTER (WHERE relevance > 0) AS first,
  sum(relevance / CASE WHEN position = 1 THEN 1 ELSE log2(position) END) FILTER (WHERE position <= 10) AS dcg, sum(relevance / CASE WHEN best = 1 THEN 1 ELSE log2(best) END) FILTER (WHERE best <= 10) AS idcg FROM s GROUP BY query)
SELECT query, found / 10.0::DOUBLE AS precision, CASE WHEN relevant > 0 THEN found / relevant ELSE 0 END AS recall, round(coalesce(ap, 0), 9) AS average_precision, coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 1 END, 9) AS ndcg FROM g""")
def retrieval_measures(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = derived.table(spark, sf, "customer").select(F.col("c_nationkey").alias("query"), F.row_number().over(w).alias("position"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("relevance"))
    m = statistics.retrieval(r)
    return m.select("query", "precision", "recall", F.round("average_precision", 9).alias("average_precision"), "reciprocal_rank", F.round("ndcg", 9).alias("ndcg"))


@query(f"""WITH {STRONG}, x AS (SELECT u, d, row_number() OVER (ORDER BY d DESC, u) AS a FROM deg), y AS (SELECT u, sum(w) AS s FROM adj GROUP BY u), z AS (SELECT u, row_number() OVER (ORDER BY s DESC, u) AS b FROM y)
SELECT round(1 - 6 * sum((a - b) * (a - b)) / (count(*)::DOUBLE * count(*) * count(*) - count(*)), 9) AS spearman FROM x JOIN z USING (u)""")
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(derived.strong(spark, sf))
    per = g.adjacency("w").groupBy("u").agg(F.count("*").alias("d"), F.sum("w").alias("s"))
    a, b = (statistics.positions(per, c, "u").select("u", F.col("position").alias(n)) for c, n in (("d", "a"), ("s", "b")))
    ranks = a.join(b, "u").select("a", "b")
    return statistics.spearman(ranks).select(F.round("spearman", 9).alias("spearman"))


@query(f"""WITH r AS (SELECT c_nationkey AS query, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position, (c_mktsegment = 'BUILDING')::INT AS relevance FROM customer),
s AS (SELECT *, sum(relevance) OVER (PARTITION BY query ORDER BY position) AS hits FROM r), g AS (SELECT query, avg(hits / position) FILTER (WHERE relevance > 0) AS ap, min(position) FILTER (WHERE relevance > 0) AS first FROM s GROUP BY query)
SELECT round(avg(coalesce(ap, 0)), 9) AS mean_average_precision, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mean_reciprocal_rank FROM g""")
def mean_retrieval_measures(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = derived.table(spark, sf, "customer").select(F.col("c_nationkey").alias("query"), F.row_number().over(w).alias("position"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("relevance"))
    return statistics.mean_retrieval(r).select(F.round("mean_average_precision", 9).alias("mean_average_precision"), F.round("mean_reciprocal_rank", 9).alias("mean_reciprocal_rank"))


@query("""WITH x AS (SELECT c_nationkey AS ranking, c_custkey AS item, floor(c_acctbal / 1000) AS a, c_custkey % 7 AS b FROM customer),
p AS (SELECT ranking, sign(x.a - y.a) AS da, sign(x.b - y.b) AS db FROM x JOIN x y USING (ranking) WHERE x.item < y.item),
g AS (SELECT ranking, sum(da * db)::DOUBLE AS s, sum(abs(da * db)) AS n, count(*) FILTER (WHERE da = 0 AND db <> 0) AS ta, count(*) FILTER (WHERE db = 0 AND da <> 0) AS tb, count(*) AS k FROM p GROUP BY ranking)
SELECT ranking, round(coalesce(s / k, 1), 9) AS tau_a, round(coalesce(CASE WHEN (n + ta) * (n + tb) > 0 THEN s / sqrt((n + ta) * (n + tb)) END, 0), 9) AS tau_b FROM (SELECT DISTINCT ranking FROM x) LEFT JOIN g USING (ranking)""")
def rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.table(spark, sf, "customer").select(F.col("c_nationkey").alias("ranking"), F.col("c_custkey").alias("item"), F.floor(F.col("c_acctbal") / 1000).alias("a"), (F.col("c_custkey") % 7).alias("b"))
    return statistics.kendall(c).select("ranking", F.round("tau_a", 9).alias("tau_a"), F.round("tau_b", 9).alias("tau_b"))
