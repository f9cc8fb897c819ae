"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A seed is a fixed mask that ignores some token positions: a masked window's hash is
that of the tokens under the mask's ones. An overlap is a window of WINDOW tokens (or
a whole shorter item) that agrees in SHARE of its tokens on one diagonal (document
position less item position). The masks are chosen so that every pattern of as many
substitutions as that allows leaves some placement of some mask untouched; so the
hashes of all masked windows of test items and documents meet in an equi join on
every diagonal that can hold an overlap. On each such diagonal the item is laid over
the document token by token, and the best window must agree in SHARE of its tokens.

Defined results: null and empty texts, and items of fewer than MIN_TOKENS tokens,
match nothing; rows that repeat a doc_id or an item_id are merged into one pair; rows
without an id match nothing; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import located, once, place_of, shared_dir, sized, stored, without_rows

#: Masks for items of so many tokens and more, up to the next entry. Each pair is hit by every pattern of 1 substitution in
#: 5 tokens, 2 in 10, and 3 in 15 as well as 4 in 20 (tests/llm tries all patterns).
MASKS = {5: ("111", "1101"), 10: ("1111", "11101"), 15: ("111011", "110100011")}
WINDOW, SHARE = 20, 0.8
MIN_TOKENS = 5
#: Tokens in the windows that one row holds of one document; the text goes along once for each row.
CELLS = 1 << 17
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT, -1), "")


def seed_hashes(hashes: Column, mask: str) -> Column:
    """The hash of the masked window at every start, for an array of token hashes."""
    offsets = [k for k, c in enumerate(mask) if c == "1"]
    starts = F.sequence(F.lit(0), F.size(hashes) - len(mask))
    return F.when(F.size(hashes) >= len(mask), F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in offsets))))


def seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """id, pos, mask and h of every masked window; rows: id, hashes."""
    arrays = F.array(*(F.coalesce(seed_hashes(F.col("hashes"), m), F.array().cast("array<bigint>")) for m in masks))
    each = rows.select("id", F.posexplode(arrays).alias("mask", "hs"))
    return each.select("id", "mask", F.posexplode("hs").alias("pos", "h"))


def hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("hashes"))


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id, size, diagonal) on which a masked window of an item of so many tokens occurs."""
    items = hashed(benchmark, "item_id").where(F.size("hashes") >= MIN_TOKENS)
    least = reduce(lambda c, n: F.when(F.size("hashes") >= n, F.lit(n)).otherwise(c), sorted(MASKS), F.lit(0))
    items = items.select(F.struct("id", F.size("hashes").alias("size")).alias("id"), "hashes", least.alias("least"))
    used = sorted(r["least"] for r in items.select("least").distinct().collect()) or [MIN_TOKENS]  # as many as MASKS has
    masks = [m for n in used for m in MASKS[n]]
    parts = [seeds(items.where(F.col("least") == n), [m]).withColumn("mask", F.lit(masks.index(m))) for n in used for m in MASKS[n]]
    of_item = reduce(DataFrame.union, parts).select(F.col("id.id").alias("item_id"), F.col("id.size").alias("size"), "mask", F.col("pos").alias("at"), "h")
    n = of_item.count()
    # The explosion keeps only the id, so that no token array is copied for each window.
    of_doc = seeds(hashed(docs, "doc_id"), masks).withColumnRenamed("id", "doc_id")
    return of_doc.join(sized(of_item, n, 48), ["h", "mask"]).select("doc_id", "item_id", "size", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()


def windows(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with words (the tokens of the document from the diagonal on, as many as the item has) and skipped (of the item's before them).

    A text is split once for many of its pairs, and only the windows leave it.
    """
    n = pairs.count()
    chunks = pairs.groupBy("doc_id").agg(F.ceil(F.sum("size") / CELLS).alias("chunks"))
    dealt = pairs.join(sized(chunks, n, 32), "doc_id").withColumn("chunk", F.pmod(F.xxhash64("item_id", "diagonal"), F.col("chunks")))
    lists = dealt.groupBy("doc_id", "chunk").agg(F.collect_list(F.struct("item_id", "size", "diagonal")).alias("hits")).drop("chunk")
    texts = docs.join(sized(pairs.select("doc_id").distinct(), n, 24), "doc_id", "left_semi").select("doc_id", "text")

    def cut(words: Column, hit: Column) -> Column:
        start = F.greatest(hit["diagonal"], F.lit(0))
        length = F.greatest(F.least(hit["diagonal"] + hit["size"], F.size(words)) - start, F.lit(0))
        return F.struct(hit["item_id"].alias("item_id"), hit["size"].alias("size"), hit["diagonal"].alias("diagonal"), (start - hit["diagonal"]).alias("skipped"), F.slice(words, start + 1, length).alias("words"))

    each = once(tokens(F.col("text")), lambda words: F.transform("hits", lambda hit: cut(words, hit)))
    return texts.join(sized(lists, n, 64), "doc_id").select("doc_id", F.explode(each).alias("hit")).select("doc_id", "hit.*")


def verified(docs: DataFrame, benchmark: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, item_id, matches and doc_from of pairs whose best window agrees enough."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).withColumn("size", F.size("item"))
    joined = windows(docs, pairs).join(sized(items, row_bytes=1024), ["item_id", "size"])
    same = lambda k: F.coalesce(F.get("words", k - F.col("skipped")) == F.get("item", k), F.lit(False)).cast("int")
    laid = F.transform(F.sequence(F.lit(0), F.col("size") - 1), same)
    flags = joined.select("doc_id", "item_id", "diagonal", laid.alias("same"), F.least(F.lit(WINDOW), F.col("size")).alias("w"))
    starts = F.sequence(F.lit(0), F.size("same") - F.col("w"))
    total = lambda s: F.aggregate(F.slice("same", s + 1, F.col("w")), F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(starts, lambda s: F.struct(total(s).alias("matches"), (-s).alias("back"))))
    found = flags.select("doc_id", "item_id", "diagonal", "w", best.alias("best")).where(F.col("best.matches") >= F.ceil(F.col("w") * SHARE))
    top = F.max(F.struct("best.matches", (-(F.col("diagonal") - F.col("best.back"))).alias("back")))
    return found.groupBy("doc_id", "item_id").agg(top.alias("t")).select("doc_id", "item_id", F.col("t.matches").alias("matches"), (-F.col("t.back")).alias("doc_from"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    shared_dir(docs.sparkSession)
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    return verified(docs, benchmark, stored(candidates(docs, benchmark), "seed-hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found; each row is judged for itself, whatever its doc_id."""
    shared_dir(docs.sparkSession)
    docs = located(docs)
    rows = docs.select(F.struct("doc_id", place_of(docs).alias("place")).alias("doc_id"), "text")
    return without_rows(docs, stored(overlaps(rows, benchmark).select("doc_id").distinct().select("doc_id.*"), "contaminated"))
