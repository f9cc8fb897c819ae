"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best-fit. Documents and the gaps of open sequences are kept
range-sorted as runs of equal size, of which there are at most as many as the
capacity, whatever the corpus holds. Each round sweeps both in ascending order:
every gap takes the longest document not longer than it that no smaller gap has
taken (its predecessor sweep; the same pairs as documents claiming the successor
gap), many claims on one run are resolved by rank within the run, the gaps shrink,
and the next round begins. Only run lengths reach the driver; ranking documents
inside their runs, in as many parts as a run is long, and placing every document
by its rank are Spark jobs.

Defined results: a null or empty text is the end id alone, one piece of one
token; ties go by rank; repeated rows are packed as often as they occur; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import shared_dir, sized, stored

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Chunks, and words of chunks, whose ids a Python worker remembers.
REMEMBERED = 100_000
#: Pieces of one length that a task ranks, on average; a longer run is dealt to as many parts as it needs.
RANKED = 20_000


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x21, 0x250)) if unicodedata.category(c)[0] == kind)


#: Chunks whose words this module splits itself: Latin text without white space, controls, or a letter that changes its length in lower case.
PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
#: Fixed value: the vocabulary's own word pattern, over those characters.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")


def byte_letters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class ChunkIds:
    """Ids of a text as little-endian unsigned 32-bit bytes, by its chunks between ASCII white space.

    This vocabulary drops white space before it splits words, so that a text's
    ids are those of its chunks put together. The first REMEMBERED chunks and words
    are remembered, which are the frequent ones.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
        if len(self.words) < REMEMBERED:
            self.words[word] = ids
        return ids

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            known = self.words
            ids = b"".join([known.get(w) or self.word(w) for w in WORD.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) < REMEMBERED and len(chunk) < 64:
            self.chunks[chunk] = ids
        return ids

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        known = self.chunks
        for text in texts:
            yield b"".join([known.get(x) or self.chunk(x) for x in text.split()])


#: One encoder for each vocabulary in a Python worker, which serves many tasks.
_ENCODERS: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkIds(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, the ids themselves of every piece."""
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    fields += [("ids", "binary")] if with_ids else []
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            texts = [x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, x in zip(rows, (key, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)], [x for x, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join(map(" ".join, fields)))


def sweep(gaps: list[list[int]], waiting: dict[int, list[int]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """One round over runs of gaps and of waiting documents.

    gaps: [gap, count, first sequence, offset]; waiting: length -> [count, first rank].
    Returns the runs of gaps afterwards and placements (length, first rank, count, first sequence, offset).
    """
    gaps.sort()
    lengths, at = sorted(waiting), 0
    open_runs: list[int] = []  # lengths not above the present gap, the longest on top
    after: list[list[int]] = []
    placed: list[tuple[int, ...]] = []
    for gap, count, first, offset in gaps:
        while at < len(lengths) and lengths[at] <= gap:
            open_runs.append(lengths[at])
            at += 1
        while count and open_runs:
            length = open_runs[-1]
            left, rank = waiting[length]
            n = min(left, count)
            placed.append((length, rank, n, first, offset))
            if gap > length:
                after.append([gap - length, n, first, offset + length])
            count, first = count - n, first + n
            waiting[length] = [left - n, rank + n]
            if left == n:
                open_runs.pop()
                del waiting[length]
        if count:
            after.append([gap, count, first, offset])
    return after, placed


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rounds of sweeps until no document waits; rows: length, first rank, count, first sequence, offset."""
    waiting = {length: [n, 0] for length, n in histogram.items() if n}
    placed: list[tuple[int, ...]] = []
    gaps: list[list[int]] = []
    sequences = 0

    def seed(lengths: list[tuple[int, int]]) -> None:
        nonlocal sequences
        for length, n in lengths:
            left, rank = waiting.pop(length)
            placed.append((length, rank, n, sequences, 0))
            if n < left:
                waiting[length] = [left - n, rank + n]
            if length < capacity:
                gaps.append([capacity - length, n, sequences, length])
            sequences += n

    seed([(length, n) for length, (n, _) in sorted(waiting.items()) if 2 * length > capacity])
    while waiting:
        gaps, new = sweep(gaps, waiting)
        placed += new
        if new or not waiting:
            continue
        # No gap takes any document: as many new sequences as the rest needs at least begin with its longest.
        need, chosen = -(-sum(length * n for length, (n, _) in waiting.items()) // capacity), []
        for length in sorted(waiting, reverse=True):
            n = min(need, waiting[length][0])
            chosen.append((length, n))
            need -= n
            if not need:
                break
        seed(chosen)
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, ranked: int = RANKED) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    shared_dir(spark)
    cut = stored(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    runs = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    place = plan(runs, capacity)
    long_runs = {length: -(-n // ranked) for length, n in runs.items() if n > ranked}
    parts = spark.createDataFrame(sorted(long_runs.items()), "length long, parts long")
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("parts"))
    salted = cut.join(F.broadcast(parts), "length", "left").withColumn("salt", F.coalesce(dealt, F.lit(0))).drop("parts")  # at most capacity rows are broadcast
    counts = stored(cut.join(F.broadcast(parts), "length").groupBy("length", dealt.alias("salt")).agg(F.count("*").alias("n")), "runs")
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("first"))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Placements are sorted by length and first rank: one search finds the row that holds a document.
        keys = place[:, 0] * (1 << 44) + place[:, 1]
        for x in frames:
            rank = x.pop("rank").to_numpy()
            hit = place[np.searchsorted(keys, x["length"].to_numpy() * (1 << 44) + rank, side="right") - 1]
            yield x.assign(sequence_id=hit[:, 3] + rank - hit[:, 1], offset=hit[:, 4])

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    in_part = salted.withColumn("rank", rank.cast("long")).join(sized(before, sum(long_runs.values())), ["length", "salt"], "left")
    in_run = in_part.withColumn("rank", F.col("rank") + F.coalesce("first", F.lit(0)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return in_run.select(*cut.columns, "rank").mapInPandas(assign, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

