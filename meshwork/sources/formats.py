"""Graph file formats as text scans and writes.

Line formats (edge lists, SNAP, triples, Matrix Market, GD4) are read line by line
with Spark's text reader and split at any byte. In formats in which a line's meaning
hangs on its section (Pajek, UCINet DL) and in GML a file is read as one row, so files
of one graph should be parts of moderate size; GML written here comes in such parts.
Header and size lines are those of each file. JSON comes as documents {meta, nodes,
edges} or as a folder of node and edge lines, which is what is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANK = r"[ \t,;]+"
NUMBER = "try_cast(get(p, {}) AS DOUBLE)"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (its place, ascending in a file) and line of every line."""
    scan = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return scan.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.trim("value").alias("line"))


def _after_first(lines: DataFrame) -> DataFrame:
    """Each file's lines but its first."""
    first = lines.groupBy("file").agg(F.min("at").alias("first"))
    return lines.join(first, "file").where("at > first").drop("first")


def edge_list(spark: SparkSession, path: str, delimiter: str = BLANK, comment: str = "#", header: bool = False) -> DataFrame:
    """src, dst and weight; short rows are dropped, a weight that is no number is null."""
    lines = _lines(spark, path)
    if header:
        lines = _after_first(lines)
    parts = lines.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit(comment))).select(F.split("line", delimiter).alias("p")).where(F.size("p") >= 2)
    return parts.select(F.get("p", 0).alias("src"), F.get("p", 1).alias("dst"), F.expr(NUMBER.format(2)).alias("weight"))


def snap(spark: SparkSession, path: str) -> DataFrame:
    return edge_list(spark, path, r"[ \t]+").select("src", "dst")


def triples(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    p = F.split("value", delimiter)
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 3).select(F.get("p", 0).alias("src"), F.get("p", 1).alias("type"), F.get("p", 2).alias("dst"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of coordinate matrices; of a symmetric one the other half is added, a skew one's with its sign turned."""
    lines = _lines(spark, path)
    banner = lines.where("lower(line) LIKE '\\\\%\\\\%matrixmarket%'").groupBy("file").agg(F.max(F.lower("line")).alias("banner"))
    rows = _after_first(lines.where(~F.startswith(F.col("line"), F.lit("%")) & (F.col("line") != "")))
    cells = rows.join(banner, "file", "left").select(F.split("line", r"\s+").alias("p"), F.coalesce("banner", F.lit("")).alias("banner")).where(F.size("p") >= 2)
    cells = cells.select(F.get("p", 0).cast("long").alias("src"), F.get("p", 1).cast("long").alias("dst"), F.expr(NUMBER.format(2)).alias("weight"), "banner")
    sign = F.when(F.contains("banner", F.lit("skew")), -1.0).otherwise(1.0)
    other = cells.where(F.contains("banner", F.lit("symmetric")) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (sign * F.col("weight")).alias("weight"))
    return cells.drop("banner").union(other)


def gd4(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id from 0, x, y) and edges of drawings: a number of vertices, a line of coordinates for each, then pairs of vertices.

    Pairs that name no vertex are dropped.
    """
    lines = _lines(spark, path).where("line <> ''")
    w = Window.partitionBy("file").orderBy("at")
    rows = lines.withColumn("k", F.row_number().over(w)).select("file", "k", F.split("line", r"\s+").alias("p"))
    n = rows.where("k = 1").select("file", F.get("p", 0).cast("long").alias("n"))
    rows = rows.where("k > 1").join(n, "file")
    vertices = rows.where("k <= n + 1").select((F.col("k") - 2).cast("long").alias("id"), F.expr(NUMBER.format(0)).alias("x"), F.expr(NUMBER.format(1)).alias("y"))
    ends = rows.where("k > n + 1").select("n", *(F.expr(f"try_cast(get(p, {i}) AS BIGINT)").alias(c) for i, c in enumerate(("src", "dst"))))
    return vertices, ends.where("src >= 0 AND dst >= 0 AND src < n AND dst < n").select("src", "dst")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("ls"))
    return whole.select("file", F.posexplode("ls").alias("n", "line")).select("file", "n", F.trim("line").alias("line")).where("line <> ''")


def _sections(lines: DataFrame, mark: Column) -> DataFrame:
    """Lines with the marker line that was read last."""
    w = Window.partitionBy("file").orderBy("n")
    return lines.withColumn("section", F.last(F.when(mark, F.lower("line")), ignorenulls=True).over(w)).where(~mark)


def _matrix_cells(rows: DataFrame) -> DataFrame:
    """src, dst, weight of the non-zero cells of matrix lines, numbered from 1 in each file."""
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("n")))
    cells = numbered.select("r", F.posexplode(F.split("line", r"\s+")).alias("c", "x"))
    return cells.select(F.col("r").cast("string").alias("src"), (F.col("c") + 1).cast("string").alias("dst"), F.expr("try_cast(x AS DOUBLE)").alias("weight")).where("weight <> 0")


def pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label) and edges (src, dst, weight, directed) of edge, arc and matrix sections."""
    rows = _sections(_numbered(spark, path).where(~F.startswith(F.col("line"), F.lit("%"))), F.startswith(F.col("line"), F.lit("*")))
    vertices = rows.where("startswith(section, '*vertices')").select(F.split("line", r"\s+")[0].alias("id"), F.nullif(F.regexp_extract("line", r'^\S+\s+"([^"]*)"', 1), F.lit("")).alias("label"))
    listed = rows.where("section RLIKE '^\\\\*(edges|arcs)'").select("section", F.split("line", r"\s+").alias("p")).where(F.size("p") >= 2)
    edges = listed.select(F.get("p", 0).alias("src"), F.get("p", 1).alias("dst"), F.coalesce(F.expr(NUMBER.format(2)), F.lit(1.0)).alias("weight"), F.startswith(F.col("section"), F.lit("*arcs")).alias("directed"))
    return vertices, edges.union(_matrix_cells(rows.where("startswith(section, '*matrix')")).withColumn("directed", F.lit(True)))


def ucinet(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of an edge list or a full matrix in DL format, ids from 1."""
    rows = _numbered(spark, path)
    head = rows.where("lower(line) LIKE 'dl %' OR lower(line) LIKE '%format%'").groupBy("file").agg(F.lower(F.array_join(F.collect_list("line"), " ")).alias("head"))
    data = _sections(rows, F.lower("line") == "data:").where("section = 'data:'").join(head, "file")
    listed = data.where("head LIKE '%edgelist%'").select(F.split("line", r"\s+").alias("p")).where(F.size("p") >= 2)
    lists = listed.select(F.get("p", 0).alias("src"), F.get("p", 1).alias("dst"), F.coalesce(F.expr(NUMBER.format(2)), F.lit(1.0)).alias("weight"))
    return lists.union(_matrix_cells(data.where("head NOT LIKE '%edgelist%'")))


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label) and edges (src, dst, weight) of flat node and edge blocks."""
    text = spark.read.text(path, wholetext=True)
    block = lambda kind: text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"\b{kind}\s*\[([^\[\]]*)\]"), 1)).alias("b"))
    field = lambda name: F.nullif(F.regexp_extract("b", rf'\b{name}\s+"?([^"\s]+(?:[^"\n]*[^"\s])?)"?', 1), F.lit(""))
    vertices = block("node").select(field("id").alias("id"), F.replace(field("label"), F.lit("&quot;"), F.lit('"')).alias("label"))
    number = F.expr("try_cast(nullif(regexp_extract(b, '\\\\b(?:value|weight)\\\\s+([-+.0-9eE]+)', 1), '') AS DOUBLE)")
    return vertices, block("edge").select(field("source").alias("src"), field("target").alias("dst"), number.alias("weight"))


def write_gml(vertices: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """Part files that make one document one after the other: header, nodes, edges and the closing bracket; no block is cut."""
    quoted = F.regexp_replace(F.coalesce(F.col("label").cast("string"), F.lit("")), '"', "&quot;")
    nodes = vertices.select(F.lit(1).alias("k"), F.format_string('  node [\n    id %s\n    label "%s"\n  ]', F.col("id").cast("string"), quoted).alias("value"))
    lines = edges.select(F.lit(2).alias("k"), F.concat(F.lit("  edge [\n    source "), F.col("src").cast("string"), F.lit("\n    target "), F.col("dst").cast("string"), F.coalesce(F.concat(F.lit("\n    value "), F.col("weight").cast("string")), F.lit("")), F.lit("\n  ]")).alias("value"))
    frame = vertices.sparkSession.createDataFrame([(0, f"graph [\n  directed {int(directed)}"), (3, "]")], "k int, value string")
    frame.union(nodes).union(lines).repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.text(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of {meta, nodes, edges} documents."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode("edges").alias("x")).select("x.*")


def write_json(vertices: DataFrame, edges: DataFrame, path: str, **meta: object) -> None:
    """A folder with lines of nodes and edges, and one of what is told of the graph."""
    vertices.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")
    spark = vertices.sparkSession
    spark.createDataFrame([(str(k), str(v)) for k, v in meta.items()], "name string, value string").coalesce(1).write.json(f"{path}/meta")


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")


def write_documents(vertices: DataFrame, edges: DataFrame, meta: DataFrame, path: str, key: str = "name") -> None:
    """One {meta, nodes, edges} document a line for each row of meta; vertices and edges say by key which document they belong to."""
    packed = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != key)))).alias(name))
    rows = meta.select(key, F.struct(*meta.columns).alias("meta")).join(packed(vertices, "nodes"), key, "left").join(packed(edges, "edges"), key, "left")
    empty = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("nodes", "edges")]
    rows.select("meta", *empty).write.json(path)


def read_documents(spark: SparkSession, path: str, key: str = "name", schema: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """meta, vertices and edges of {meta, nodes, edges} documents, one a line; vertices and edges carry the key of their document.

    Without a schema it is read off the documents, which takes one node and one edge at least.
    """
    docs = spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    part = lambda c: docs.select(F.col("meta")[key].alias(key), F.explode(c).alias("x")).select(key, "x.*")
    return docs.select("meta.*"), part("nodes"), part("edges")


EXTENSIONS = {"gml": "gml", "net": "pajek", "paj": "pajek", "mtx": "matrix_market", "dl": "ucinet", "json": "json", "snap": "snap", "tsv": "triples", "csv": "edge_list", "txt": "edge_list", "edges": "edge_list", "gd4": "gd4"}


def detect(spark: SparkSession, path: str) -> str:
    """The format of a file by how it begins, or else by its ending; `edge_list` where neither tells."""
    head = [r["value"].strip() for r in spark.read.text(path).where("trim(value) <> ''").limit(5).collect()]
    first = head[0].lower() if head else ""
    starts = (("%%matrixmarket", "matrix_market"), ("*vertices", "pajek"), ("*network", "pajek"), ("dl ", "ucinet"), ("graph [", "gml"), ("graph[", "gml"), ("creator", "gml"), ("{", "json"))
    for mark, kind in starts:
        if first.startswith(mark):
            return kind
    if len(head) > 1 and head[0].isdigit() and len(head[1].split()) == 2:
        return "gd4"
    return EXTENSIONS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "edge_list")


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """src and dst, and what else the format has for an edge, of a file in any of the formats."""
    readers = {
        "edge_list": edge_list, "snap": snap, "triples": triples, "matrix_market": matrix_market, "ucinet": ucinet, "gd4": lambda s, p: gd4(s, p)[1], "pajek": lambda s, p: pajek(s, p)[1],
        "gml": lambda s, p: gml(s, p)[1], "json": lambda s, p: read_json(s, p)[1],
    }
    return readers[kind or detect(spark, path)](spark, path)
