"""Exact deduplication as a stateful stream over keyed state on disk.

Every row becomes a small arrival record: digest of its normalised text, stable
identifier, length and content locator (file and row in it). A Structured Streaming
query folds the arrivals into one state entry per digest, held by RocksDB without a
watermark, so an entry never expires. Each micro-batch checks its hits at once: the
whole texts of the rows that hit an entry, and the text that the entry's locator
names, are read, and of each entry the least and the greatest bytes must be equal.
Entries of which they differ are dealt anew by the bytes themselves.

With a state_path the state, and the arrivals that it was made from, outlive the
call: a later call takes further documents and judges them against all before.

Defined results: a null text counts as empty; ties of length go to the smallest
doc_id, a null doc_id after all others, and then to the first row by file and place;
rows that repeat a doc_id are told apart by their place, so one row of a group stays
whatever repeats; an empty table gives no rows; columns other than doc_id and text
are not read, and kept by `deduplicate` whatever their names. docs is a scan of
files, filtered and projected at will; a frame that no file holds is written first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import located, place_of, scratch_path, shared_dir, sized, stored, without_rows

#: White space that does not count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of an entry beyond which the entry goes to its rows instead of gathering them.
SALT_ROWS = 1000
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # Stores of a query that ended are closed at the next maintenance, and hold their native memory until then.
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.metricsEnabled": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    docs = located(docs)
    at = docs.metadataColumn("_metadata")
    return docs.select(
        "doc_id",
        digest(normalised(F.col("text"))).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        at["file_path"].alias("file"),
        at["row_index"].alias("row"),
        place_of(docs).alias("place"),
    )


def _batches(spark: SparkSession, folder: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in fs.listStatus(p)) if fs.exists(p) else []


def stream_state(log: DataFrame, log_path: str, files_per_batch: int | None = None, state_path: str | None = None, check: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Fold the arrival files below log_path into the state and return one row per digest.

    state_path keeps the stream's checkpoint: a later call with the same one only
    reads files that arrived since. check is given the entries of several rows that
    a micro-batch changed and names the digests whose texts differ; with it, they
    are returned beside the state.
    """
    spark = log.sparkSession
    base = state_path or scratch_path(spark, "dedup-state")
    schema = "digest string, group_size long, keep_id {}, keep_file string, keep_row long, keep_place long".format(log.schema["doc_id"].dataType.simpleString())
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(log.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        best = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row", "place")
        state = reader.parquet(log_path).groupBy("digest").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))

        def upsert(batch: DataFrame, number: int) -> None:
            path = f"{base}/updates/batch={number:09d}"
            batch.select("digest", "group_size", *(F.col(f"best.{c}").alias(f"keep_{n}") for c, n in (("doc_id", "id"), ("file", "file"), ("row", "row"), ("place", "place")))).write.mode("overwrite").parquet(path)
            if check:
                hits = spark.read.schema(schema).parquet(path).where("group_size > 1")
                check(hits).select("digest").write.mode("overwrite").parquet(f"{base}/collisions/batch={number:09d}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(upsert).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    batches = _batches(spark, f"{base}/updates")
    entries = spark.createDataFrame([], schema)
    if batches:
        # Each batch writes the entries that it changed; an entry's last update is its state.
        entries = spark.read.schema(schema).parquet(*batches)
    if len(batches) > 1:
        s = F.struct("group_size", "keep_id", "keep_file", "keep_row", "keep_place")
        # The file's name holds the batch, and a later state of an entry has more rows.
        entries = entries.groupBy("digest").agg(F.max_by(s, "group_size").alias("s")).select("digest", "s.*")
    if not check:
        return entries
    found = _batches(spark, f"{base}/collisions")
    return entries, (spark.read.schema("digest string").parquet(*found) if found else spark.createDataFrame([], "digest string")).distinct()


def texts_at(spark: SparkSession, keepers: DataFrame) -> DataFrame:
    """digest and text of the rows that keep_file and keep_row name: only those files are read."""
    files = [r["keep_file"] for r in keepers.select("keep_file").distinct().collect()]  # names of input files, as a scan's plan holds
    if not files:
        return spark.createDataFrame([], "digest string, text string")
    scan = spark.read.parquet(*files)
    at = scan.metadataColumn("_metadata")
    rows = scan.select("text", at["file_path"].alias("keep_file"), at["row_index"].alias("keep_row"))
    return rows.join(sized(keepers, row_bytes=300), ["keep_file", "keep_row"]).select("digest", "text")


def differing(docs: DataFrame, log: DataFrame, hits: DataFrame, resumed: bool = False) -> DataFrame:
    """Digests of hits (entries of several rows) whose normalised texts are not all the same bytes.

    Each task holds an entry's least and greatest bytes only, so a group of any size spreads over all tasks.
    """
    spark = docs.sparkSession
    rows = log.join(sized(hits.select("digest"), row_bytes=80), "digest").select("digest", F.col("doc_id").alias("_id"), F.col("place").alias("_place"))
    rows = stored(rows, "dedup-hits")
    placed = docs.select("doc_id", "text", place_of(docs).alias("place"))
    texts = placed.join(sized(rows, row_bytes=90), (F.col("place") == F.col("_place")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("digest", "text")
    if resumed:  # an entry's row may have come with an earlier call
        mine = rows.select("digest", F.col("_place").alias("keep_place"))
        texts = texts.unionByName(texts_at(spark, stored(hits.join(mine, ["digest", "keep_place"], "left_anti").join(rows.select("digest").distinct(), "digest", "left_semi"), "dedup-keepers")))
    body = F.encode(normalised(F.col("text")), "UTF-8")
    return texts.groupBy("digest").agg(F.min(body).alias("low"), F.max(body).alias("high")).where("low <> high").select("digest")


def rows_with_entries(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state_path: str | None = None) -> DataFrame:
    """doc_id, place, digest, keep_id, group_size and kept of every row of docs (which has locators)."""
    spark = docs.sparkSession
    log_path = f"{state_path}/arrivals" if state_path else scratch_path(spark, "dedup-arrivals")
    resumed = bool(state_path) and bool(_batches(spark, log_path))
    arrived = stored(arrivals(docs, digest), "dedup-arrived") if state_path else arrivals(docs, digest)
    arrived.write.mode("append").parquet(log_path)
    log = arrived if state_path else spark.read.schema(arrived.schema).parquet(log_path)
    state, mixed = stream_state(log, log_path, files_per_batch, state_path and f"{state_path}/state", lambda hits: differing(docs, log, hits, resumed))
    out = with_state(log, state).select("doc_id", "place", "digest", "keep_id", "group_size", (F.col("keep_place").eqNullSafe(F.col("place")) & F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
    mixed = stored(mixed, "dedup-collisions")
    return out if mixed.isEmpty() else regrouped(docs, out, mixed, digest)


def assign(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state_path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest."""
    shared_dir(docs.sparkSession)
    docs = located(docs.select("doc_id", "text"))
    return rows_with_entries(docs, digest, files_per_batch, state_path).select("doc_id", "keep_id", "group_size", "kept", "digest")


def with_state(log: DataFrame, state: DataFrame) -> DataFrame:
    """Each arrival with its entry. Entries of many rows, of which there are few, go to the arrivals instead of gathering theirs."""
    state = stored(state.select("digest", "group_size", "keep_id", "keep_place"), "dedup-entries")
    hot = sized(state.where(F.col("group_size") > SALT_ROWS), row_bytes=160)
    rest = log.join(hot.select("digest"), "digest", "left_anti").join(state.where(F.col("group_size") <= SALT_ROWS), "digest")
    return log.join(hot, "digest").unionByName(rest)


def regrouped(docs: DataFrame, out: DataFrame, mixed: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that stand for different bytes (of this call's documents): their rows are dealt anew by the bytes themselves."""
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", place_of(docs).alias("place"), digest(norm).alias("digest"), norm.alias("body"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))
    full = rows.join(sized(mixed), "digest", "left_semi")
    best = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place"))
    groups = full.groupBy("digest", "body").agg(F.count("*").alias("group_size"), best.alias("best"))
    kept = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.place") == F.col("place"))
    again = full.join(groups, ["digest", "body"]).select("doc_id", "place", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"))
    return out.join(sized(mixed), "digest", "left_anti").select(again.columns).union(again)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    shared_dir(docs.sparkSession)
    docs = located(docs)
    return without_rows(docs, stored(rows_with_entries(docs).where("NOT kept").select("doc_id", "place"), "dedup-gone"))
