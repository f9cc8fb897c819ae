"""SimHash near-duplicates compared in bit-sliced blocks.

A document's fingerprint takes the majority bit over the 64-bit hashes of its
word shingles. Distinct fingerprints are dealt into buckets by pairs of bit
ranges: with BLOCKS ranges, two fingerprints that differ in at most RADIUS bits
agree on all bits of some BLOCKS - RADIUS of them, so no link is lost. Inside a
bucket, bit planes are stored vertically and the distances from many members to
64 others a word are counted at once by carry-save addition; members of which
all distances exceed the radius are abandoned on the way.

Defined results: a null or empty text has fingerprint zero and links like any
other; repeated rows share fingerprint and component; null doc_ids count last
for component_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import located, min_labels, place_of, shared_dir, sized, stored, without_rows

SEED = 42
#: Words hashed at a time, which bounds the memory that a very long text takes.
CHUNK_WORDS = 50_000
BLOCKS = 5
#: Members compared with each other at once in memory, and most members of a bucket in one task.
BLOCK_ROWS = 256
TILE_ROWS = 16_384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, CHUNK_WORDS):
        part = words[at : min(at + CHUNK_WORDS, total) + shingle - 1]
        hashes = np.array([digest(join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)), strict=False)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, a signed long with the bits of the fingerprint."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", fp("text").alias("fp"))


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of (n, words) fingerprints: row b holds bit b of all of them, 64 a word; n is a multiple of 64."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry bits of three bits each."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(queries: np.ndarray, members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of queries and members, (n, words) unsigned 64-bit, that differ in at most radius bits.

    Seven planes of differences at a time are reduced by carry-save adders to three
    and added to vertical counters that start so far below their range that they
    overflow beyond the radius; a query is abandoned once all members overflowed.
    """
    m, ones = len(members), np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.zeros((-(-m // 64) * 64, members.shape[1]), np.uint64)
    padded[:m] = members
    planes = planes_of(padded)
    asked = np.where(np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little"), ones, np.uint64(0)).T
    size = max(1, radius.bit_length())
    spare = np.packbits(np.arange(len(padded)) >= m, bitorder="little").view(np.uint64)
    rows = np.arange(len(queries))
    shape = (len(queries), planes.shape[1])
    first = (1 << size) - 1 - radius
    counter = [np.full(shape, ones if first >> k & 1 else np.uint64(0)) for k in range(size)]
    over = np.broadcast_to(spare, shape).copy()
    for at in range(0, len(planes), 7):
        d = [planes[b] ^ asked[b, rows][:, None] for b in range(at, min(at + 7, len(planes)))]
        d += [np.zeros_like(over)] * (7 - len(d))
        s1, c1 = carry_save(*d[:3])
        s2, c2 = carry_save(*d[3:6])
        s, c3 = carry_save(s1, s2, d[6])
        added = (s, *carry_save(c1, c2, c3))
        carry = None
        for k in range(max(size, 3)):
            x = added[k] if k < 3 else None
            if k >= size:  # this weight alone is beyond the radius
                over |= x
            elif x is None:
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            elif carry is None:
                counter[k], carry = counter[k] ^ x, counter[k] & x
            else:
                counter[k], carry = carry_save(counter[k], x, carry)
            if k == size - 1:
                over |= carry
        if at >= 14:
            alive = (over != ones).any(axis=1)
            if not alive.all():
                rows, over, counter = rows[alive], over[alive], [c[alive] for c in counter]
                if not len(rows):
                    break
    ok = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")[:, :m] if len(rows) else np.zeros((0, m), np.uint8)
    r, c = np.nonzero(ok)
    return rows[r], c


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    return label


def links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what is linked among values; as few as there are values at most."""
    starts = range(0, len(values), BLOCK_ROWS)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for i in starts:
        for j in starts[: i // BLOCK_ROWS + 1]:
            x, y = within(values[i : i + BLOCK_ROWS], values[j : j + BLOCK_ROWS], radius)
            at = x + i > y + j
            nodes, edge = np.unique(np.concatenate([x[at] + i, y[at] + j]), return_inverse=True)
            top = roots(len(nodes), edge[: at.sum()], edge[at.sum() :])
            star = top != np.arange(len(nodes))
            a.append(nodes[star])
            b.append(nodes[top[star]])
    x, y = np.concatenate(a), np.concatenate(b)
    top = roots(len(values), x, y)
    star = np.nonzero(top != np.arange(len(values)))[0]
    return star, top[star]


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of nodes within buckets that arrive one after the other; columns bucket, node and the words.

    Small buckets share a block, which adds only true links.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, last = 0, None

    def out() -> pa.RecordBatch:
        nodes, first = np.unique(np.concatenate([x for x, _ in held]), return_index=True)
        x, y = links(np.concatenate([w for _, w in held])[first], radius)
        return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, node, *words = (c.to_numpy() for c in batch.columns)
        table = np.column_stack(words).view(np.uint64)
        cuts = [0, *(np.nonzero(bucket[1:] != bucket[:-1])[0] + 1).tolist(), len(node)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if n >= BLOCK_ROWS and bucket[x] != last:
                yield out()
                held, n = [], 0
            held.append((node[x:y], table[x:y]))
            n, last = n + y - x, bucket[x]
    if held:
        yield out()


def bucket_keys(fp: F.Column, radius: int = 3, blocks: int = BLOCKS) -> list[F.Column]:
    """For each choice of blocks - radius bit ranges, a hash-free key of those bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (y - x)) - 1) << x for x, y in zip(edges, edges[1:], strict=False)]
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(masks[k] for k in chosen)
        keys.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def bucket_links(nodes: DataFrame, keys: list[F.Column], words: list[str], radius: int) -> DataFrame:
    """Star edges (a, b) that connect the nodes which share a key and differ in at most radius bits of their words."""
    keyed = nodes.select("node", F.posexplode(F.array(*keys)).alias("part", "key"))
    shared = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1").select("part", "key", F.ceil(F.col("n") / TILE_ROWS).alias("chunks"))
    members = keyed.join(shared, ["part", "key"])
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    # A bucket beyond TILE_ROWS is dealt to one task for each pair of its chunks.
    tiles = members.select("part", "key", "node", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("d"))
    named = tiles.select(F.xxhash64("part", "key", F.least("c", "d"), F.greatest("c", "d")).alias("bucket"), "node")
    named = named.join(sized(nodes.select("node", *(F.col(w).alias(f"_{w}") for w in words)), row_bytes=8 + 8 * len(words)), "node").select("bucket", "node", *(f"_{w}" for w in words))
    return named.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: compare(it, radius), "a long, b long")


def components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row; all fingerprints within the radius are linked."""
    shared_dir(docs.sparkSession)
    fps = stored(fingerprints(docs, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp"))
    labels = min_labels(bucket_links(nodes, bucket_keys(F.col("fp"), radius), ["fp"], radius))
    grouped = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    first = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = stored(grouped.join(first, "label").select("fp", "component_id"), "components")
    return fps.join(sized(by_fp), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Least hashes of a document: BANDS keys of ROWS values each. A pair of similarity 0.8 shares no key with a chance of
#: (1 - 0.8 ** ROWS) ** BANDS = 5e-6, whatever else the table holds.
BANDS, ROWS = 40, 6
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
OFFSETS = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
MIXERS = _draw.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents and shingles of a group that one task takes at once; larger groups are dealt by pairs of such chunks.
CHUNK_DOCS, CHUNK_SHINGLES = 4096, 1 << 21


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one whole text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    total, parts = len(words) - shingle + 1, []
    for at in range(0, total, CHUNK_WORDS):
        part = words[at : min(at + CHUNK_WORDS, total) + shingle - 1]
        parts.append(np.unique(np.array([digest(join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)), strict=False)], np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def identity(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    x = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS least values over the shingles."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 256):
        np.minimum(low, (high[at : at + 256, None] * FACTORS + OFFSETS).min(axis=0), out=low)
    return (low.reshape(BANDS, ROWS).astype(np.uint64) * MIXERS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges of trees that connect what is linked: sets of at least this Jaccard similarity.

    A search from each set compares with those not reached yet only, so nothing that could connect is passed over.
    """
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    sizes = np.array([len(x) for x in sets])
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), bool)
    a: list[int] = []
    b: list[int] = []
    left = np.nonzero(sizes)[0]
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = (sizes[left] >= similarity * sizes[x] - 1) & (similarity * sizes[left] - 1 <= sizes[x])
            tried = left[near]
            if not len(tried):
                continue
            mark[ids[x]] = True
            starts = np.cumsum(sizes[tried]) - sizes[tried]
            both = np.add.reduceat(mark[np.concatenate([ids[k] for k in tried])], starts, dtype=np.int64)
            mark[ids[x]] = False
            hit = both / (sizes[x] + sizes[tried] - both) >= similarity
            found = tried[hit].tolist()
            a += [x] * len(found)
            b += found
            front += found
            near[near] = hit
            left = left[~near]
    return a, b


def verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of nodes within buckets that arrive one after the other; columns bucket, node and the shingle set."""
    held: dict[int, np.ndarray] = {}
    last = None

    def out() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            nodes = np.fromiter(held, np.int64, len(held))
            x, y = similar_links(list(held.values()), similarity)
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])

    for batch in batches:
        for bucket, node, x in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
            if bucket != last:
                yield from out()
                held, last = {}, bucket
            held[node] = np.frombuffer(x.as_py(), np.uint64)
    yield from out()


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """node and label of nodes (node, keys) that sharing keys connects; nodes that share none are absent."""
    keyed = nodes.select("node", F.posexplode("keys").alias("part", "key"))
    shared = keyed.groupBy("part", "key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z")
    shared = stored(shared, "shared-keys")
    return min_labels(keyed.join(sized(shared, row_bytes=24), ["part", "key"]).select("a", F.col("node").alias("b")))


def similar_rows(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """doc_id, place, component_id and kept of every row of docs (with locators); of a component the smallest doc_id's row is kept."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, BLOCK_ROWS) for batch in batches for at in range(0, batch.num_rows, BLOCK_ROWS))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = [(identity(x), len(x), band_keys(x)) for x in (shingle_set(t.as_py(), shingle) for t in batch.column("text"))]
            node, n, keys = zip(*rows, strict=True)
            ends = pa.array(range(0, BANDS * len(rows) + 1, BANDS), pa.int32())
            columns = [batch.column("doc_id"), batch.column("place"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "node", "n", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([identity(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    rows = docs.select("doc_id", place_of(docs).alias("place"), "text")
    fps = stored(rows.mapInArrow(prints, f"doc_id {doc_type}, place long, node long, n long, keys array<long>"), "shingle-keys")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).alias("least")
    nodes = fps.groupBy("node").agg(least, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = stored(nodes, "shingle-nodes")
    groups = candidate_groups(nodes)
    members = nodes.select("node", "least", "n").join(sized(groups, row_bytes=16), "node", "left").withColumn("label", F.coalesce("label", "node"))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES))
    large = members.groupBy("label").agg(F.count("*").alias("size"), chunks.alias("chunks")).where("size > 1").drop("size")
    wanted = stored(members.join(sized(large, row_bytes=16), "label").select("node", "least", "label", "chunks"), "candidates")
    n = wanted.count()
    ids = wanted.select(F.col("least.doc_id").alias("_id"), F.col("least.place").alias("_at"))
    sets = rows.join(sized(ids, n, 24), (F.col("place") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(sets_of, "node long, hashes binary")
    # A group beyond a chunk is dealt to one task for each pair of its chunks; a set that comes again counts once.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    tiles = sets.join(sized(wanted.drop("least"), n, 32), "node").select("node", "label", "hashes", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("d"))
    tiles = tiles.select(F.xxhash64("label", F.least("c", "d"), F.greatest("c", "d")).alias("bucket"), "node", "hashes")
    links = tiles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: verify(it, similarity), "a long, b long")
    labels = min_labels(links)
    named = stored(nodes.select("node", "least").join(sized(labels, row_bytes=16), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "similar-nodes")
    first = named.groupBy("label").agg(F.min("least").alias("first"))
    by_node = stored(named.join(sized(first, row_bytes=32), "label").select("node", "first"), "similar-components")
    kept = F.col("first.place").eqNullSafe(F.col("place")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    return fps.select("doc_id", "place", "node").join(sized(by_node, row_bytes=32), "node", "left").select("doc_id", "place", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id and component_id of every row; documents link whose shingle sets have this Jaccard similarity.

    Sets that share a band of least hashes are candidates, and groups of candidates
    hold all links among them. Inside a group the sets themselves are compared. The
    bands are the same for every table, so two documents are treated alike in all.
    A text without words links to others without; a null doc_id counts last.
    """
    shared_dir(docs.sparkSession)
    return similar_rows(located(docs.select("doc_id", "text")), similarity, shingle).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs that stay: of each group of near copies one row, that of the smallest doc_id."""
    shared_dir(docs.sparkSession)
    docs = located(docs)
    return without_rows(docs, stored(similar_rows(docs, similarity, shingle).where("NOT kept").select("doc_id", "place"), "near-copies"))
