"""Queries that plant paths in graphs of the tables, and the vertices within reach of some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.statistics import draw
from meshwork.graph import Graph, checkpointed
from meshwork.operators import planting, traversal
from meshwork.plans.graph_queries import STRONG, _strong
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


def _draw(*columns: str) -> str:
    return f"(('0x' || left(md5(concat_ws(':', '42', {', '.join(columns)})), 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _first_nations(spark: SparkSession, sf: str) -> DataFrame:
    return derived.suppliers(spark, sf).where("nation < 3")


def _reach_sql(u: str, v: str, depth: int | None) -> str:
    near = "" if depth is None else f" AND hops < {depth}"
    hops = ("", "", "") if depth is None else (", 0 AS hops", ", hops + 1", ", hops")
    return f"""WITH RECURSIVE {STRONG}, r AS (SELECT s_suppkey AS id{hops[0]} FROM supplier WHERE s_nationkey < 3 UNION SELECT {v}{hops[1]} FROM r JOIN strong ON {u} = r.id{near})
SELECT * FROM strong WHERE src IN (SELECT id FROM r WHERE id IN (SELECT u FROM deg)) AND dst IN (SELECT id FROM r)"""


@query(_reach_sql("src", "dst", None))
def reachable_forward(spark: SparkSession, sf: str) -> DataFrame:
    """What the suppliers of three nations reach along arcs from smaller to larger ids."""
    return traversal.reachable(_strong(spark, sf), _first_nations(spark, sf)).edges


@query(_reach_sql("dst", "src", 2))
def reachable_backward(spark: SparkSession, sf: str) -> DataFrame:
    """What leads to them within two arcs."""
    return traversal.reachable(_strong(spark, sf), _first_nations(spark, sf), True, 2).edges


_NOISE = f"""WITH {STRONG}, n AS (SELECT u AS id, row_number() OVER (ORDER BY u) - 1 AS number FROM deg), c AS (SELECT count(*) AS n, max(id) AS top FROM n),
d AS (SELECT k, floor({_draw('k', "'from'")} * c.n)::BIGINT AS a, floor({_draw('k', "'to'")} * c.n)::BIGINT AS b, 1 + floor({_draw('k', "'length'")} * 4)::INT AS hops, top FROM c, range((SELECT count(*) FROM supplier)) r(k) WHERE c.n > 1),
p AS (SELECT k, hops, [x.id] || list_transform(range(1, hops), lambda i: top + k * 3 + i) || [y.id] AS nodes FROM d JOIN n x ON x.number = a JOIN n y ON y.number = b WHERE a <> b),
s AS (SELECT *, CASE WHEN nodes[1] > nodes[-1] THEN list_reverse(nodes) ELSE nodes END AS sign FROM p),
decoy AS (SELECT * FROM s WHERE sign NOT IN (SELECT [src, dst] FROM strong) QUALIFY row_number() OVER (PARTITION BY sign ORDER BY k) = 1)"""


def _noise(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """As many draws as there are suppliers; the edges themselves are the true paths."""
    g = _strong(spark, sf)
    g = Graph(g.edges.select("src", "dst", F.col("w").alias("weight")))
    return planting.noise(g, g.edges.select(F.array("src", "dst").alias("nodes")), derived.suppliers(spark, sf).count())


@query(f"{_NOISE} SELECT k, array_to_string(nodes, '-') AS path, hops FROM decoy")
def noise_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _noise(spark, sf)[1].select("k", F.array_join("nodes", "-").alias("path"), "hops")


@query(f"""{_NOISE}, e AS (SELECT nodes, unnest(range(1, len(nodes))) AS i FROM decoy), f AS (SELECT DISTINCT nodes[i] AS src, nodes[i + 1] AS dst FROM e)
SELECT src, dst, w::DOUBLE AS weight FROM strong UNION ALL SELECT src, dst, round(0.3 * {_draw('src', 'dst')}, 9) FROM f""")
def noisy_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _noise(spark, sf)[0].edges.withColumn("weight", F.round("weight", 9))


@query(f"""WITH {STRONG}, n AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY {_draw('s_suppkey')}, s_suppkey) - 1 AS number FROM supplier),
m AS (SELECT 'author' AS kind, -1 - n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS number, count(*) OVER () AS n FROM nation UNION ALL SELECT 'venue', -1 - r_regionkey, row_number() OVER (ORDER BY r_regionkey DESC) - 1, count(*) OVER () FROM region),
t AS (SELECT number // 3 AS k, max(CASE WHEN number % 3 = 0 THEN id END) AS a, max(CASE WHEN number % 3 = 1 THEN id END) AS b, max(CASE WHEN number % 3 = 2 THEN id END) AS c FROM n GROUP BY 1 HAVING count(*) = 3),
p AS (SELECT 'chain' AS kind, k, a, b, c, [[a, b], [b, c]] AS arcs FROM t UNION ALL SELECT 'co_citation', k, a, b, c, [[b, a], [b, c]] FROM t UNION ALL SELECT 'coupling', k, a, b, c, [[a, b], [c, b]] FROM t
  UNION ALL SELECT m.kind, x.number, x.id, m.id, y.id, [[x.id, m.id], [y.id, m.id]] FROM n x JOIN n y ON y.number = x.number + 1 JOIN m ON m.number = x.number % m.n),
e AS (SELECT kind, k, a, b, c, unnest(arcs) AS arc FROM p),
own AS (SELECT kind, arc, min(k) AS k FROM e WHERE arc NOT IN (SELECT [src, dst] FROM strong) GROUP BY ALL)
SELECT kind, k, concat_ws('-', a, b, c) AS path, round(avg(0.5 + 0.5 * {_draw('arc[1]', 'arc[2]')}), 9) AS relevance FROM e JOIN own USING (kind, arc, k) GROUP BY kind, k, a, b, c HAVING count(*) = 2""")
def citation_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers are works; nations stand for authors, regions for venues."""
    g, count = _strong(spark, sf), derived.suppliers(spark, sf).count()
    works = checkpointed(planting.numbered(derived.suppliers(spark, sf).select("id"), draw(42, F.col("id"))))
    long = lambda c: (-1 - F.col(c)).cast(works.schema["id"].dataType).alias("id")
    mediators = {"author": derived.table(spark, sf, "nation").select(long("n_nationkey")), "venue": derived.table(spark, sf, "region").select(long("r_regionkey"))}
    out = None
    for kind in planting.ARCS:
        one = planting.cited(g, works, kind, count, mediators.get(kind))[1].withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "k", F.array_join("nodes", "-").alias("path"), F.round("relevance", 9).alias("relevance"))


@query(f"""WITH n AS (SELECT s_suppkey AS id, s_suppkey % 3 AS type, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) - 1 AS number, count(*) OVER (PARTITION BY s_suppkey % 3) AS n FROM supplier),
d AS (SELECT k, {_draw('k', '0')} AS x, {_draw('k', '1')} AS y, {_draw('k', '2')} AS z FROM range((SELECT count(*) FROM supplier)) r(k))
SELECT min(k) AS k, concat_ws('-', a.id, b.id, c.id) AS path FROM d JOIN n a ON a.type = 0 AND a.number = floor(x * a.n) JOIN n b ON b.type = 1 AND b.number = floor(y * b.n) JOIN n c ON c.type = 0 AND c.number = floor(z * c.n)
WHERE a.id <> c.id GROUP BY 2""")
def typed_plantings(spark: SparkSession, sf: str) -> DataFrame:
    """Paths from a vertex of one class of ids over one of the next back to the first class."""
    all_of = derived.suppliers(spark, sf)
    types = all_of.select("id", (F.col("id") % 3).cast("string").alias("type"))
    return planting.typed(_strong(spark, sf), types, ["0", "1", "0"], all_of.count())[1].select("k", F.array_join("nodes", "-").alias("path"))
