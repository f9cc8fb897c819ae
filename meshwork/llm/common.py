"""Helpers shared by the training-data operators: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes that a join side may have and still be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


#: Rows and bytes that a Python worker is handed at once, unless the session sets them: whole texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(16 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Bound what a batch holds for this session. Results are read lazily, so the bound has to outlive the call."""
    for key, (default, bound) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, bound)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where a local session has none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="meshwork-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    small_batches(spark)
    return base


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, as it may lie in any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/meshwork-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove_path(spark, path)
        except Exception:  # the session is already gone: nothing is left to delete with
            return

    atexit.register(drop)
    return path


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions begun inside give their shuffle files back when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that `stored` wrote and that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/meshwork-" in path:
                remove_path(df.sparkSession, path)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row even where a lambda inside reads it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def set_aside(docs: DataFrame, used: tuple[str, ...], results: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """docs as its used columns and one struct of all others, whose names can then clash with nothing, and the columns that docs had.

    Columns called like one of the results are left out.
    """
    names = [c for c in docs.columns if c.lower() not in results]
    others = [c for c in names if c.lower() not in used]
    packed = docs.select(*used, *([F.struct(*(docs[c] for c in others)).alias("set_aside")] if others else []))
    return packed, [F.col("set_aside").getField(c).alias(c) if c in others else F.col(c.lower()).alias(c) for c in names]


def sized(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Mark df for broadcast only when its counted rows prove it small; otherwise leave the join to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else df


def located(docs: DataFrame) -> DataFrame:
    """docs with a file and a row for each of its rows: itself, or what is written of it where no file holds it."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return stored(docs, "input")
    return docs


def place_of(docs: DataFrame) -> Column:
    """A hash of a row's locator; with the doc_id it names the row."""
    at = docs.metadataColumn("_metadata")
    return F.xxhash64(at["file_path"], at["row_index"])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs (with locators) that gone (doc_id, place) does not name, with all their columns."""
    here = unused(docs.columns, "place")
    placed = docs.withColumn(here, place_of(docs))
    named = gone.select(F.col("doc_id").alias(f"{here}_id"), F.col("place").alias(f"{here}_at"))
    return placed.join(sized(named, row_bytes=24), (placed[here] == named[f"{here}_at"]) & placed["doc_id"].eqNullSafe(named[f"{here}_id"]), "left_anti").select(docs.columns)


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (a, b), as (node, label) with the smallest node as label.

    Alternates linking larger neighbours and smaller neighbours to the smallest
    one until the edge set is a forest of stars, which takes a logarithmic number
    of rounds. Each round groups by node after the duplicates are merged, and its
    outcome is written to the shared folder. Nodes without an edge are absent.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, n = None, e.count()
    while True:
        # Large star: every neighbour greater than u links to the smallest of u and its neighbours. A vertex of very
        # many neighbours would gather in one task, so its label goes to the edges where all labels are few enough.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(sized(least, 2 * n, 16), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(low, 2 * n, 16), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("x"))
        nxt = stored(small.select(F.col("x.u").alias("u"), F.col("x.w").alias("v")).where("u <> v").distinct(), "edges")
        dropped(e)
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before, n, e = now, now[0], nxt
