"""WARC archives: writing one record a page and reading them back by verified record boundaries.

Writing: equal payloads of MIN_REVISIT bytes and more share one response record;
the others are revisit records without a payload. Spark's text writer lays the
records down, so archives can lie in any store.

Reading: archives are cut at every occurrence of the record magic, wherever the
splits fall. Each piece is only a candidate record; its header names the offset
of its successor. Pointer jumping from the start of each file retains the
candidates on the chain of successors, in as many rounds as the logarithm of the
longest chain; magic inside a payload is never reached and its piece goes back to
the record that holds it.

Defined results: null html is an empty payload and is read back as one; a null
page_id is written without an id and read back as null, and is a revisit of a
named equal; rows that repeat the largest page_id of equal payloads are all
responses; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.llm.common import scratch_path, shared_dir, sized, stored

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
#: Fixed values of the written headers.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID = "urn:page:"
FIELDS = {"kind": rb"WARC-Type", "uri": rb"WARC-Target-URI", "name": rb"WARC-Record-ID", "digest": rb"WARC-Payload-Digest", "refers": rb"WARC-Refers-To"}
PIECE = "file string, block long, before long, size long, kind string, uri string, name string, digest string, refers string, head long, content long, sha1 string, body binary"


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, sha1, record_type and refers_to of every page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    keyed = rows.withColumn("same", F.when(F.octet_length("payload") >= min_revisit, F.sha2("payload", 256)))
    groups = keyed.where("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("same", "first")
    # The count proves the side small before it is broadcast.
    groups = stored(groups, "warc-groups")
    joined = keyed.join(sized(groups, row_bytes=120), "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record(page: DataFrame) -> Column:
    """The text of a record without the blank lines that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the pages as uncompressed WARC files below path."""
    rows = with_roles(pages, min_revisit)
    rows.select(record(rows).alias("value")).write.option("lineSep", END).option("compression", "none").text(path)


def parse_piece(piece: bytes) -> dict | None:
    """The header of a candidate record that follows the magic, or None where there is no whole header."""
    end = piece.find(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", piece[: max(end, 0)])
    if end < 0 or not length:
        return None
    found = {k: re.search(rb"(?im)^" + v + rb":[ \t]*([^\r\n]*)", piece[:end]) for k, v in FIELDS.items()}
    return {k: m and m[1].strip().decode("utf-8", "replace") for k, m in found.items()} | {"head": end + 4, "content": int(length[1])}


def pieces(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """Every piece between two occurrences of the magic, with its place in its split and its header if it has one."""
    scan = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, before = None, 0
        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in PIECE.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != split:
                    split, before = (file, block), 0
                got = parse_piece(piece) or {}
                whole = bool(got) and len(piece) >= got["head"] + got["content"]
                body = piece[got["head"] : got["head"] + got["content"]] if whole else None
                got |= {"file": file, "block": block, "before": before, "size": len(piece) + len(MAGIC), "sha1": None if body is None else hashlib.sha1(body).hexdigest(), "body": piece if bodies else None}
                before += len(piece) + len(MAGIC)
                for column, x in zip(out, names, strict=True):
                    column.append(got.get(x))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return scan.mapInArrow(parse, PIECE)


def placed(found: DataFrame) -> DataFrame:
    """Pieces with their absolute offset: the bytes of a file's earlier splits and of the split's earlier pieces."""
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    base = splits.withColumn("base", F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).drop("bytes")
    at = F.col("base") + F.col("before") - len(MAGIC)
    return found.join(sized(base, row_bytes=300), ["file", "block"]).withColumn("at", at).where("at >= 0").withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + F.col("content") + len(END))


def reachable(records: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain from each file's start; records: file, at, next."""
    jump = records.select("file", "at", "next").where("next IS NOT NULL")
    marked, count = jump.where("at = 0").select("file", "at"), -1
    while True:
        step = marked.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        marked = stored(marked.union(step.join(records.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "warc-marked")
        n = marked.count()
        if n == count:
            return marked
        count = n
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "warc-jump")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records below path: page_id, uri, record_type, refers_to, payload_bytes, payload_digest and, on request, payload.

    A revisit has the payload of the response that it refers to, found by id and digest.
    """
    shared_dir(spark)
    found = placed(stored(pieces(spark, path).drop("body"), "warc-pieces"))
    chain = reachable(found.where("head IS NOT NULL").select("file", "at", "next"))
    valid = stored(found.join(chain, ["file", "at"]), "warc-valid")
    short = valid.where("sha1 IS NULL").select("file", F.col("at").alias("start"), "head", "content")
    rows = valid.select("file", "at", "kind", "uri", "name", "digest", "refers", "content", "sha1")
    if payloads or not short.isEmpty():
        whole = joined_bodies(spark, path, valid if payloads else valid.where("sha1 IS NULL"), valid)
        rows = rows.join(whole, ["file", "at"], "left").withColumn("sha1", F.coalesce("sha1", "sha1_whole"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<{ID}(-?[0-9]+)>', 1), '') AS BIGINT)")
    extra = ["payload"] if payloads else []
    rows = rows.select(number("name").alias("page_id"), "uri", F.col("kind").alias("record_type"), number("refers").alias("refers_to"), F.col("content").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.expr("substring(digest, 6)").alias("told"), *extra)
    responses, revisits = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'")
    source = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told"), F.col("payload_bytes"), *extra).dropDuplicates(["refers_to", "told"])
    # The copies of one page spread over salts, the page's own row is dealt to each of them.
    per = revisits.groupBy("refers_to", "told").agg(F.ceil(F.count("*") / 1000).alias("salts"))
    dealt = source.join(per, ["refers_to", "told"]).withColumn("salt", F.explode(F.sequence(F.lit(1).cast("long"), "salts"))).drop("salts")
    salted = revisits.drop("payload_bytes", "payload_digest", *extra).join(sized(per, row_bytes=80), ["refers_to", "told"]).withColumn("salt", F.pmod(F.xxhash64("page_id"), "salts") + 1)
    back = salted.join(dealt, ["refers_to", "told", "salt"], "left").withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("told")))
    columns = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", *extra]
    return responses.select(columns).unionByName(back.select(columns))


def joined_bodies(spark: SparkSession, path: str, wanted: DataFrame, valid: DataFrame) -> DataFrame:
    """(file, at, payload, sha1_whole) of wanted records, put together from all pieces up to the next record."""
    parts = placed(pieces(spark, path, bodies=True)).select("file", "at", "body")
    marks = parts.select("file", "at").join(valid.select("file", "at", F.col("at").alias("own")), ["file", "at"], "left")
    owner = marks.withColumn("start", F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))).drop("own")
    chosen = wanted.select("file", F.col("at").alias("start"), "head", "content")
    held = parts.join(owner.join(chosen, ["file", "start"]), ["file", "at"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "body")))
    merged = held.groupBy("file", "start").agg(ordered.alias("list"), F.first("head").alias("head"), F.first("content").alias("content"))
    glue = F.lit(bytearray(MAGIC))
    raw = F.aggregate(F.slice("list", 2, F.greatest(F.size("list") - 1, F.lit(0))), F.col("list")[0]["body"], lambda a, x: F.concat(a, glue, x["body"]))
    body = F.substring(raw, F.col("head").cast("int") + 1, F.col("content").cast("int"))
    return merged.select("file", F.col("start").alias("at"), body.alias("payload")).withColumn("sha1_whole", F.sha1("payload"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages, read the archives back and return what they say of every page."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
