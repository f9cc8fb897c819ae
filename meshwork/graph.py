"""The graph model: immutable vertex and edge DataFrames with a direction flag."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where a local session has none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshwork-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    The table's size is that of its files. A checkpointed plan keeps the size that
    was estimated for it, the product of what each join multiplied, which doubles its
    digits with every round of a loop.
    """
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, tuple]:
    """checkpointed df, and aggregates over its rows that are taken while it is written, which saves a job for them."""
    seen = Observation()
    return checkpointed(df.observe(seen, *(a.alias(f"a{k}") for k, a in enumerate(aggregates)))), tuple(seen.get[f"a{k}"] for k in range(len(aggregates)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, as it may lie in any store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*frames: DataFrame | None) -> None:
    """Delete tables that `checkpointed` wrote and that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            if "/meshwork-step-" in path:
                remove(df.sparkSession, path)


#: Most rows and bytes that a join side may have and still be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def sized(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Mark df for broadcast only when its counted rows prove it small; otherwise leave the join to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else df


#: Most rows of a side that every round of a loop joins and that is still broadcast.
LOOP_ROWS = 20_000


def looped(df: DataFrame, rows: int) -> DataFrame:
    """As sized, for a side with one row a key that a loop joins in every round: all that rounds broadcast passes through the driver.

    Larger sides shuffle and are hashed part by part, which also keeps Spark from broadcasting them by their size.
    """
    return F.broadcast(df) if rows <= LOOP_ROWS else df.hint("shuffle_hash")


#: Rows and pairs that one task of a self-join takes.
PART_ROWS = 500_000


def in_parts(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to as many parts as its counted rows ask for, so what a task holds does not grow with the table."""
    n = df.count() if rows is None else rows
    return df.repartition(max(1, -(-n // PART_ROWS)), *keys)


def meeting_items(rows: DataFrame, key: str, item: str, repeats: bool = True) -> DataFrame:
    """a < b of items that come under one key, and n, how often; without repeats an item counts once a key."""
    c = F.count("*")
    n, pairs = rows.groupBy(key).agg(c.alias("c")).agg(F.sum("c"), F.sum(F.expr("c * (c - 1) div 2"))).first()
    one = in_parts(rows.select(F.col(key).alias("k"), F.col(item).alias("a")), "k", rows=n or 0)
    one = one if repeats else one.distinct()
    met = one.join(one.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b")
    return in_parts(met, "a", "b", rows=pairs or 0).groupBy("a", "b").agg(c.alias("n"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/meshwork-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is already gone: nothing is left to delete with
            return

    atexit.register(drop)
    return path


@dataclass(frozen=True)
class Graph:
    """vertices: id and attributes; edges: src, dst and optionally weight, type and attributes."""

    edges: DataFrame
    vertices: DataFrame | None = None
    directed: bool = False

    def stored(self) -> Graph:
        """The same graph with its edges (and vertices) computed once; loops start with it."""
        return Graph(checkpointed(self.edges), None if self.vertices is None else checkpointed(self.vertices), self.directed)

    def undirected(self) -> Graph:
        """Each pair of different vertices once, smaller id first, whatever directions and copies there were."""
        pairs = self.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        return Graph(pairs, self.vertices)

    def ids(self) -> DataFrame:
        if self.vertices is not None:
            return self.vertices.select("id").distinct()
        return self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()

    def adjacency(self, *columns: str) -> DataFrame:
        """u, v and columns of every step: both ways on an undirected graph, a loop once."""
        one = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), *columns)
        if self.directed:
            return one
        return one.union(self.edges.where("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), *columns))

    def neighbours(self) -> DataFrame:
        """Distinct (u, v) without loops, both ways whatever the direction."""
        plain = self.edges.where("src <> dst")
        return plain.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(plain.select("dst", "src")).distinct()

    def degrees(self) -> DataFrame:
        """id, out_degree, in_degree, degree; an undirected edge counts once at each end."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        counted = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))
        if self.vertices is None:
            return counted
        return self.ids().join(counted, "id", "left").na.fill(0, ["out_degree", "in_degree", "degree"])

    def induced(self, ids: DataFrame) -> Graph:
        """The named vertices that exist, and the edges with both ends among them."""
        keep = ids.select("id").distinct()
        edges = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(self.edges.columns)
        return Graph(edges, None if self.vertices is None else self.vertices.join(keep, "id", "left_semi"), self.directed)

    def filtered(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Vertices that satisfy a predicate, and edges that satisfy theirs between them."""
        edges = self.edges if edge is None else self.edges.where(edge)
        if vertex is None or self.vertices is None:
            return Graph(edges, self.vertices, self.directed)
        return Graph(edges, self.vertices, self.directed).induced(self.vertices.where(vertex))

    def of_types(self, types: list[str]) -> Graph:
        return Graph(self.edges.where(F.col("type").isin(types)), self.vertices, self.directed)

    def either(self, vertex: Column, edge: Column) -> Graph:
        """Vertices that satisfy the one or touch an edge that satisfies the other, with those edges only."""
        edges = self.edges.where(edge)
        ids = self.vertices.where(vertex).select("id").union(edges.select("src")).union(edges.select("dst")).distinct()
        return Graph(edges, self.vertices.join(ids, "id", "left_semi"), self.directed)

    def csr(self) -> DataFrame:
        """src and its sorted (dst, weight) list."""
        weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in self.edges.columns else F.lit(1.0)
        rows = Graph(self.edges.withColumn("weight", weight), None, self.directed).adjacency("weight")
        return rows.groupBy(F.col("u").alias("src")).agg(F.sort_array(F.collect_list(F.struct(F.col("v").alias("dst"), "weight"))).alias("targets"))
