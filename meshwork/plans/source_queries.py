"""Queries that write graphs of the tables in each format and read them back, with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.graph import checkpointed, scratch
from meshwork.plans.graph_queries import STRONG, TRADE, _strong
from meshwork.sources import derived, formats

QUERIES: dict = {}
SQL: dict[str, str] = {}

_STRONG_SQL = f"WITH {STRONG} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, w::DOUBLE AS weight FROM strong"
_TRADE_SQL = f"WITH {TRADE} SELECT (src + 1)::VARCHAR AS src, (dst + 1)::VARCHAR AS dst, w::DOUBLE AS weight FROM trade"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _line(*columns: str | Column, by: str = " ") -> Column:
    return F.concat_ws(by, *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))


def _written(lines: DataFrame, name: str) -> str:
    """Part files of the lines, in whatever order."""
    path = scratch(lines.sparkSession, name)
    lines.select(F.col("value")).write.text(path)
    return path


def _in_order(parts: list[DataFrame], name: str) -> str:
    """One file of sections, one after the other: formats whose lines hang on their section are read file by file."""
    rows = None
    for k, part in enumerate(parts):
        one = part.select(F.lit(k).alias("k"), "value")
        rows = one if rows is None else rows.union(one)
    path = scratch(rows.sparkSession, name)
    rows.repartition(1).sortWithinPartitions("k", "value").select("value").write.text(path)
    return path


def _head(spark: SparkSession, *lines: str) -> list[DataFrame]:
    return [spark.createDataFrame([(x,)], "value string") for x in lines]


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    """The trade graph with ids from 1."""
    return checkpointed(derived.trade(spark, sf).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "w"))


@query(_STRONG_SQL)
def read_edge_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = _strong(spark, sf).edges.select(_line("src", "dst", "w", by=",").alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("",), ("alone",)], "value string")
    return formats.load(spark, _written(lines.union(noise), "edges"))


@query(_STRONG_SQL.replace(", w::DOUBLE AS weight", ""))
def read_snap(spark: SparkSession, sf: str) -> DataFrame:
    lines = _strong(spark, sf).edges.select(_line("src", "dst", by="\t").alias("value"))
    return formats.snap(spark, _written(lines.union(spark.createDataFrame([("# FromNodeId\tToNodeId",)], "value string")), "snap"))


@query(f"WITH {STRONG} SELECT src::VARCHAR AS src, 'shares' || w AS type, dst::VARCHAR AS dst FROM strong")
def read_triples(spark: SparkSession, sf: str) -> DataFrame:
    lines = _strong(spark, sf).edges.select(_line("src", F.concat(F.lit("shares"), F.col("w")), "dst", by="\t").alias("value"))
    return formats.triples(spark, _written(lines, "triples"))


@query(f"WITH {STRONG} SELECT u AS src, v AS dst, w::DOUBLE AS weight FROM adj")
def read_matrix_market(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    n = g.edges.count()
    cells = g.edges.select(_line("src", "dst", "w").alias("value"))
    return formats.load(spark, _in_order([*_head(spark, "%%MatrixMarket matrix coordinate real symmetric", "% made from a table", f"9999 9999 {n}"), cells], "matrix"))


@query(_TRADE_SQL.replace("AS weight", "AS weight, true AS directed"))
def read_pajek(spark: SparkSession, sf: str) -> DataFrame:
    t = _trade(spark, sf)
    names = spark.range(1, 26).select(F.concat(F.col("id"), F.lit(' "nation '), F.col("id"), F.lit('"')).alias("value"))
    return formats.load(spark, _in_order([*_head(spark, "*Vertices 25"), names, *_head(spark, "*Arcs"), t.select(_line("src", "dst", "w").alias("value"))], "pajek"))


@query(_TRADE_SQL)
def read_ucinet(spark: SparkSession, sf: str) -> DataFrame:
    t = _trade(spark, sf)
    return formats.load(spark, _in_order([*_head(spark, "dl n=25 format=edgelist1", "data:"), t.select(_line("src", "dst", "w").alias("value"))], "ucinet"))


@query(_STRONG_SQL)
def read_gml(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    path = scratch(spark, "gml")
    formats.write_gml(g.ids().select("id", F.concat(F.lit('the "'), F.col("id"), F.lit('"')).alias("label")), g.edges.select("src", "dst", F.col("w").alias("weight")), path)
    return formats.gml(spark, path)[1]


@query(f"WITH {STRONG} SELECT u::VARCHAR AS id, 'the \"' || u || '\"' AS label FROM deg")
def read_gml_vertices(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    path = scratch(spark, "gml")
    formats.write_gml(g.ids().select("id", F.concat(F.lit('the "'), F.col("id"), F.lit('"')).alias("label")), g.edges.select("src", "dst", F.col("w").alias("weight")), path)
    return formats.gml(spark, path)[0]


@query(f"WITH {STRONG} SELECT src, dst, w AS weight FROM strong")
def read_json(spark: SparkSession, sf: str) -> DataFrame:
    g = _strong(spark, sf)
    path = scratch(spark, "json")
    formats.write_json(g.ids(), g.edges.select("src", "dst", F.col("w").alias("weight")), path, name="strong", directed=False)
    return formats.read_json_lines(spark, path)[1].select("src", "dst", "weight")


@query(f"WITH {TRADE} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM trade WHERE src < 20 AND dst < 20")
def read_gd4(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty vertices; edges of the other nations name no vertex and are dropped."""
    places = spark.range(20).select(F.format_string("%d.5 %d.25", "id", "id").alias("value"))
    edges = derived.trade(spark, sf).select(_line("src", "dst").alias("value"))
    return formats.load(spark, _in_order([*_head(spark, "20"), places, edges], "gd4"))


_DOCS = f"WITH {STRONG}, n AS (SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier), e AS (SELECT x.nation, src, dst, w FROM strong JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE x.nation = y.nation)"


def _documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A document for each nation: its suppliers and the strong edges between them, written and read again."""
    n = derived.suppliers(spark, sf).withColumnRenamed("nation", "name")
    e = _strong(spark, sf).edges.join(n.withColumnRenamed("id", "src"), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst").where("name = other").select("name", "src", "dst", F.col("w").alias("weight"))
    path = scratch(spark, "documents")
    formats.write_documents(n, e, n.groupBy("name").agg(F.count("*").alias("suppliers")).withColumn("directed", F.lit(False)), path)
    schema = "meta struct<name: bigint, suppliers: bigint, directed: boolean>, nodes array<struct<id: bigint>>, edges array<struct<src: bigint, dst: bigint, weight: bigint>>"
    return formats.read_documents(spark, path, schema=schema)


@query(f"{_DOCS} SELECT nation AS name, src, dst, w AS weight FROM e")
def read_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf)[2].select("name", "src", "dst", "weight")


@query(f"{_DOCS} SELECT nation AS name, count(*) AS suppliers, false AS directed, count(*) AS nodes FROM n GROUP BY nation")
def read_document_meta(spark: SparkSession, sf: str) -> DataFrame:
    meta, nodes, _ = _documents(spark, sf)
    return meta.join(nodes.groupBy("name").agg(F.count("*").alias("nodes")), "name").select("name", "suppliers", "directed", "nodes")
