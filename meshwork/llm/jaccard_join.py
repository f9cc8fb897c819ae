"""Documents whose sets of word n-grams overlap by a share of their union, by a grouped prefix join.

All sets are put into one order, rarest n-grams first. Two sets that are similar
enough share one of their first n - ceil(share * n) + 1 n-grams, their prefixes.
Documents of equal sets are one class; classes of equal size and equal prefix are
one group. Groups that share an n-gram of their prefixes make a pair where their
sizes, the n-gram's positions and the number of shared prefix n-grams still allow
the overlap; then the groups are expanded, and their members' sets compared.

Rarity is a count of n-grams over all documents in COUNTERS counters by hash. The
counters only choose the order, and every order gives the same links. An n-gram in
the prefixes of more than LIST groups stands in near copies of one text; pairs of
such a list would grow with its square, so its groups are tied to its smallest one
instead. What pairs and ties connect is compared together, where a search from
each set compares with those it has not reached. No link is lost either way.

Defined results: a text of fewer than three words is one n-gram; null texts and
texts without words have no set and link with nothing; repeated rows are in one
component; a null doc_id counts last for component_id; an empty table gives no
rows; other columns are not read. N-grams are compared by 64-bit hashes inside a
pair of sets, equal sets and groups are found by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import located, min_labels, place_of, shared_dir, sized, stored
from meshwork.llm.simhash import shingle_set, verify

#: Counters of n-grams, and how many of them one row of the sums holds.
COUNTER_BITS, SLICE_BITS = 22, 10
#: Tokens that a task gathers before it counts them.
GATHERED = 1 << 20
#: Most groups with one prefix n-gram that are paired one by one.
LIST = 64
#: Documents and n-grams of connected candidates that one task takes at once; more are dealt by pairs of such chunks.
CHUNK_DOCS, CHUNK_SHINGLES = 1024, 1 << 20


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with any set of that similarity."""
    return -(-percent * n // 100)


def prefix(hashes: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first elements in the common order, one of which every similar set has among its own."""
    order = np.lexsort((hashes, ranks[counter_of(hashes)]))
    return hashes[order[: len(hashes) - least_overlap(len(hashes), percent) + 1]]


def rarity(rows: DataFrame, shingle: int) -> np.ndarray:
    """The rank of each counter's sum over the n-grams of all rows; 16 MB whatever the input."""
    width = 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(shingle_set(text.as_py(), shingle))
                n += len(held[-1])
                if n >= GATHERED:
                    counts += np.bincount(counter_of(np.concatenate(held)), minlength=len(counts))
                    held, n = [], 0
        if held:
            counts += np.bincount(counter_of(np.concatenate(held)), minlength=len(counts))
        table = counts.astype(np.uint32).reshape(-1, width)
        used = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(used), 256):
            part = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([x.tobytes() for x in table[part]], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["slice"].to_pylist(), batch["counts"], strict=True):
                new = np.frombuffer(x.as_py(), np.uint32)
                sums[k] = sums[k] + new if k in sums else new.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    summed = rows.select("text").mapInArrow(count, "slice long, counts binary").repartition("slice").mapInArrow(add, "slice long, counts binary")
    total = np.zeros((1 << COUNTER_BITS - SLICE_BITS, width), np.int64)
    for row in summed.toLocalIterator():  # as many rows as there are slices
        total[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return np.unique(total.reshape(-1), return_inverse=True)[1].astype(np.uint32)


def described(rows: DataFrame, ranks: Broadcast, percent: int, shingle: int) -> DataFrame:
    """doc_id, place, set (its 128-bit name), n, grp (that of size and prefix) and the prefix of every row."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
                first = [prefix(x, ranks.value, percent) if len(x) else x for x in sets]
                names = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                groups = [xxhash.xxh3_128_digest(len(x).to_bytes(8, "little") + p.tobytes()) for x, p in zip(sets, first, strict=True)]
                ends = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
                tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first).view(np.int64)))
                columns = [batch.column("doc_id"), batch.column("place"), pa.array(names, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(groups, pa.binary()), tokens]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "set", "n", "grp", "tokens"])

    return rows.mapInArrow(run, f"doc_id {doc_type}, place long, set binary, n long, grp binary, tokens array<long>")


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """Elements that sets of these sizes share if they are similar enough."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def group_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between groups (g, n, tokens): pairs that pass the filters, and ties of the n-grams in many groups."""
    entries = groups.select("g", "n", F.posexplode("tokens").alias("pos", "token"))
    lists = stored(entries.groupBy("token").agg(F.count("*").alias("groups"), F.min("g").alias("least")).where("groups > 1"), "prefix-lists")
    short, many = lists.where(F.col("groups") <= LIST), stored(entries.join(sized(lists.where(F.col("groups") > LIST), row_bytes=24), "token").select("g", "least"), "frequent-prefixes")
    members = entries.join(sized(short.select("token"), row_bytes=16), "token").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "g", "pos"))).alias("x"))
    met = members.select("x", F.posexplode("x").alias("i", "s")).select("s", F.explode(F.slice("x", F.col("i") + 2, LIST)).alias("t"))
    rest = F.least(F.col("s.n") - F.col("s.pos"), F.col("t.n") - F.col("t.pos"))
    met = met.where(100 * F.col("s.n") >= percent * F.col("t.n")).select(F.col("s.g").alias("a"), F.col("t.g").alias("b"), F.col("s.n").alias("an"), F.col("t.n").alias("bn"), rest.alias("rest"))
    pairs = met.groupBy("a", "b", "an", "bn").agg(F.count("*").alias("shared"), F.max("rest").alias("rest"))
    # All that is common comes from the first shared element on, and is a shared prefix element or stands after the longer
    # prefix. Elements of frequent lists are in neither count, so they are granted to both.
    extra = stored(many.groupBy("g").agg(F.count("*").alias("more")), "frequent-counts")
    n = extra.count()
    for end in ("a", "b"):
        pairs = pairs.join(sized(extra.select(F.col("g").alias(end), F.col("more").alias(f"{end}_more")), n, 24), end, "left")
    granted, needed = F.least(F.coalesce("a_more", F.lit(0)), F.coalesce("b_more", F.lit(0))), overlap_needed(F.col("an"), F.col("bn"), percent)
    kept = pairs.where((F.col("rest") + granted >= needed) & (F.col("shared") + granted + F.ceil(percent * F.col("bn") / F.lit(100)) - 1 >= needed))
    return kept.select("a", "b").union(many.select(F.col("least").alias("a"), F.col("g").alias("b")))


def components(docs: DataFrame, percent: int = 90, shingle: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = located(docs.select("doc_id", "text"))
    rows = rows.select("doc_id", place_of(rows).alias("place"), "text")
    ranks = spark.sparkContext.broadcast(rarity(rows, shingle))
    named = stored(described(rows, ranks, percent, shingle), "prefixes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).alias("least")
    classes = named.where("n > 0").groupBy("set").agg(least, F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("tokens").alias("tokens"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = stored(nodes.groupBy("grp").agg(F.min("node").alias("g"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "groups")
    shared = nodes.select("grp", F.col("node").alias("b")).join(sized(groups.where("members > 1").select("grp", F.col("g").alias("a")), row_bytes=32), "grp").select("a", "b")
    candidates = min_labels(group_pairs(groups, percent).union(shared))
    candidates = candidates.union(candidates.select("label", "label").distinct())
    members = nodes.select("node", "least", "n").join(sized(candidates, row_bytes=16), "node")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES))
    wanted = stored(members.join(sized(members.groupBy("label").agg(chunks.alias("chunks")), row_bytes=16), "label").select("node", "least", "label", "chunks"), "candidates")
    links = verified(rows, wanted, percent, shingle)
    labels = min_labels(links)
    joined = stored(nodes.select("set", "node", "least").join(sized(labels, row_bytes=16), "node", "left").select("set", "least", F.coalesce("label", "node").alias("label")), "linked")
    first = joined.groupBy("label").agg(F.min("least").alias("first"))
    by_set = stored(joined.join(sized(first, row_bytes=32), "label").select("set", F.col("first.doc_id").alias("component_id")), "components")
    out = named.select("doc_id", "set", "n").join(sized(by_set, row_bytes=48), "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def verified(rows: DataFrame, wanted: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Edges (a, b) of trees that connect what is similar among the wanted nodes of a label; their sets are compared."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "chunks")), pa.array(sets, pa.binary())], ["node", "label", "chunks", "hashes"])

    ids = wanted.select(F.col("least.doc_id").alias("_id"), F.col("least.place").alias("_at"), "node", "label", "chunks")
    texts = rows.join(sized(ids, row_bytes=56), (F.col("place") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = texts.select("node", "label", "chunks", "text").mapInArrow(sets_of, "node long, label long, chunks long, hashes binary")
    # More than a chunk is dealt to one task for each pair of its chunks; a set that comes again counts once.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    tiles = sets.select("node", "label", "hashes", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("d"))
    tiles = tiles.select(F.xxhash64("label", F.least("c", "d"), F.greatest("c", "d")).alias("bucket"), "node", "hashes")
    return tiles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: verify(it, percent / 100), "a long, b long")
