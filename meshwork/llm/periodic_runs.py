"""Periodic runs of words: stretches that repeat with a smallest period q, at least four times and six words long.

The words that equal the word q places on are counted for all lags q at once. Of
rare words all pairs of places are subtracted; the indicators of words that are
frequent in the text are correlated with themselves by Fourier transforms, whose
rounding errors stay below 1e-5 for texts of up to 10**9 words, so that rounding to
whole numbers is exact. A run of period q has 3q matches at least (five for q = 1),
so only lags with that many are scanned for islands of consecutive matches. Matches
that a run of a period dividing q already explains are taken off first: none of
them belongs to a run whose smallest period is q.

Each text is judged for itself inside the task that reads it; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; repeated rows are
judged each; all columns are kept whatever they are called (`found` says where the
new ones are); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from meshwork.llm.common import small_batches, unused

#: Least length of a run in words and in periods.
WORDS, PERIODS = 6, 4
RUNS = ArrayType(StructType([StructField(x, LongType()) for x in ("start", "length", "period")]))
ARROW_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def heavy_matches(codes: np.ndarray, heavy: np.ndarray, limit: int) -> np.ndarray:
    """For lags 0 to limit, the number of places where a heavy word stands again that far on."""
    size = 1 << (len(codes) + limit).bit_length()
    power = np.zeros(size // 2 + 1)
    for word in heavy:
        spectrum = np.fft.rfft((codes == word).astype(np.float64), size)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: limit + 1]).astype(np.int64)


def light_matches(codes: np.ndarray, light: np.ndarray, limit: int) -> np.ndarray:
    """The same for words of few places, by the differences of their places: first to the next one, then to the one after it, and on."""
    places = np.flatnonzero(light[codes])
    places = places[np.argsort(codes[places], kind="stable")]
    word = codes[places]
    counts = np.zeros(limit + 1, np.int64)
    at, step = np.arange(len(places)), 0
    while len(at):
        step += 1
        at = at[at + step < len(places)]
        at = at[word[at + step] == word[at]]
        lag = places[at + step] - places[at]
        near = lag <= limit
        at = at[near]  # a word's places ascend, so later steps only lead further away
        counts += np.bincount(lag[near], minlength=limit + 1)
    return counts


def matches(codes: np.ndarray, limit: int) -> np.ndarray:
    """For lags 0 to limit, the number of words that equal the word that far on."""
    often = np.bincount(codes)
    heavy = often > max(64, int((len(codes) * np.log2(len(codes) + 1)) ** 0.5))
    counts = light_matches(codes, ~heavy, limit)
    return counts + heavy_matches(codes, np.flatnonzero(heavy), limit) if heavy.any() else counts


def prime_divisors(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + [q] * (q > 1)


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(codes)
    if n < WORDS:
        return []
    limit = n // PERIODS
    counts = matches(codes, limit)
    lags = np.arange(limit + 1)
    need = np.maximum(WORDS, PERIODS * lags) - lags
    found: list[tuple[int, int, int]] = []
    for q in (np.flatnonzero(counts[1:] >= need[1:]) + 1).tolist():
        if counts[q] < need[q]:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes[:-q] == codes[q:], [False])).view(np.int8)))
        start, end = edges[::2], edges[1::2]
        long = end - start >= need[q]
        for s, e in zip(start[long].tolist(), (end[long] + q).tolist(), strict=True):
            if any(np.array_equal(codes[s : e - q // r], codes[s + q // r : e]) for r in prime_divisors(q)):
                continue  # a smaller period, which divides q as the stretch is four times as long
            found.append((s, e - s, q))
            again = np.arange(2 * q, min(limit, e - s - 1) + 1, q)
            counts[again] -= e - s - again
    return sorted((s, length, q) for s, length, q in found)


def judge(text: bytes | None) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, runs, and the words left when each run keeps its first period."""
    words = (text or b"").split()  # of bytes: ASCII white space only
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = runs_of(codes)
    if not runs:
        return len(words), runs, b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return len(words), runs, b" ".join(compress(words, keep.tolist()))


def found(columns: list[str]) -> tuple[str, str, str]:
    """What find calls its columns on a table with these columns: n_words, runs and collapsed, with underscores before where taken."""
    return tuple(unused(columns, name) for name in ("n_words", "runs", "collapsed"))


def find(docs: DataFrame) -> DataFrame:
    """docs with the number of words, the runs (start, length, period) and the text in which each run keeps its first period."""
    small_batches(docs.sparkSession)
    n_words, runs, collapsed = found(docs.columns)
    body = unused([*docs.columns, n_words, runs, collapsed], "body")
    asked = docs.withColumn(body, F.col("text").cast("binary"))
    schema = StructType([*docs.schema.fields, StructField(n_words, LongType()), StructField(runs, RUNS), *asked.select(F.col(body).alias(collapsed)).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            lists = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs, _ in rows]
            new = [pa.array([r[0] for r in rows], pa.int64()), pa.array(lists, ARROW_RUNS), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    out = asked.mapInArrow(run, schema)
    return out.withColumn(collapsed, F.col(collapsed).cast("string"))
