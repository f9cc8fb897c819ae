"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Rules are host and path prefix as they stand in the url. A list holds URLs in any
spelling, which are made canonical: user info, port and spare dots of the host are
dropped, the path is unescaped, empty and dot segments are resolved. A listed URL
covers the canonical form of a url on its host and all subdomains; its path covers
what lies below it where it is empty or ends with a slash, and itself otherwise. A
url is therefore covered exactly when one of its keys (kind, host suffix, path
prefix or whole path) equals a listed key, and the suffix and prefix lengths worth
trying are those that occur in the list. Keys pass a split-block Bloom filter (one
256-bit block of eight 32-bit words a key, one bit in each word); only possible hits
meet the list in a hash join, which removes the false positives.

Defined results: a null url, or one without `://`, has an empty host and path and
no entry covers it; verdicts depend on host and path alone, so repeated rows and
repeated page_ids share them; a url whose escapes are broken keeps them; null and
empty listed urls list nothing; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import shared_dir, sized, stored

#: Rules as (rule, verdict), and junk host names of the public example domains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
JUNK_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
EXAMPLE_DOMAINS = ("example.com", "example.net", "example.org")
#: Odd multipliers, one for each word of a block (fixed values of the split-block Bloom filter).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Listed keys a block, and most blocks that a filter may have and still be broadcast.
BLOCK_KEYS = 16
ENTRY = "kind string, host string, path string, verdict string, rule string, rank int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """host without user info and port, dots that start, end or follow another one."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.trim(F.regexp_replace(bare, r"\.{2,}", "."), F.lit("."))


def canonical_path(path: Column) -> Column:
    """path unescaped, without empty and dot segments."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin("", "."), done).otherwise(F.concat(done, F.array(x)))
    parts = F.aggregate(F.split(plain, "/", -1), F.array().cast("array<string>"), step)
    folder = F.when(F.regexp_like(plain, F.lit(r"(^|/)\.{0,2}$")) & (F.size(parts) > 0), "/").otherwise("")
    resolved = F.when(plain == "", "").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/"), folder))
    # Possessive, as Java's engine keeps a frame for each segment that it may go back on.
    return F.when(F.regexp_like(plain, F.lit(r"^(?:/[^/.][^/]*+)*+/?$")), plain).otherwise(resolved)


def rule_entries(spark, rules=RULES) -> DataFrame:
    """kind, host, path, verdict, rule and rank of the rules."""
    rows = [("rule", r[: r.index("/")], r[r.index("/") :], v, r, 1) for r, v in rules]
    return spark.createDataFrame(rows, ENTRY)


def default_list(spark) -> DataFrame:
    """url of the listed junk hosts."""
    return spark.createDataFrame([(f"http://{n}.{d}",) for n in JUNK_NAMES for d in EXAMPLE_DOMAINS], "url string")


def listed_entries(listed: DataFrame) -> DataFrame:
    """The same columns of a table of urls to block."""
    at = listed.where("url <> ''").select(canonical_host(host_of(F.col("url"))).alias("host"), canonical_path(path_of(F.col("url"))).alias("path")).distinct()
    kind = F.when((F.col("path") == "") | F.endswith(F.col("path"), F.lit("/")), "below").otherwise("page")
    return at.where("host <> ''").select(kind.alias("kind"), "host", "path", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("rank"))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks))


def bits_of(key: Column) -> list[Column]:
    """One bit of each of the eight words of a block, from the low half of the key's hash."""
    low = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in SALTS]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The non-empty blocks of the filter of column key: block, w0 .. w7."""
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits_of(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(SALTS))))


def possible_hits(keys: DataFrame, bloom: DataFrame, blocks: int, rows: int) -> DataFrame:
    """Rows of keys whose eight bits are all set in their block."""
    probed = keys.withColumn("block", block_of(F.col("key"), blocks)).join(sized(bloom, rows, 72), "block")
    test = reduce(lambda a, b: a & b, (F.col(f"w{k}").bitwiseAND(b) == b for k, b in enumerate(bits_of(F.col("key")))))
    return probed.where(test).select(*keys.columns)


def key_of(kind: Column, host: Column, path: Column) -> Column:
    return F.concat(kind, F.lit("\n"), host, F.lit("\n"), path)


def each_key(kind: str, hosts: Column, paths: Column) -> Column:
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: key_of(F.lit(kind), h, p))))


def url_keys(urls: DataFrame, shapes: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """host, path and each key worth trying; shapes: label counts of hosts and lengths of paths by kind of entry.

    Rules look at host and path as they stand, listed urls at the canonical ones.
    """
    wide = urls.withColumns({"_host": canonical_host(F.col("host")), "_path": canonical_path(F.col("path"))})
    keys = []
    for kind, (labels, lengths) in shapes.items():
        host, path = ("host", "path") if kind == "rule" else ("_host", "_path")
        parts = F.split(host, r"\.", -1)
        suffix = F.array_compact(F.array(*(F.when(F.size(parts) >= n, F.substring_index(host, ".", -n)) for n in labels)))
        prefix = F.array(F.col(path)) if kind == "page" else F.array_compact(F.array(*(F.when(F.char_length(path) >= m, F.substring(path, 1, m)) for m in lengths)))
        keys.append(each_key(kind, suffix, prefix))
    return wide.select("host", "path", F.explode(F.concat(*keys)).alias("key"))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; listed: column url.

    Of the entries that cover a url rules go before listed urls, then the longest
    entry wins, then the smallest. No entry: allow.
    """
    spark = pages.sparkSession
    shared_dir(spark)
    entries = listed_entries(default_list(spark) if listed is None else listed)
    if rules:
        entries = rule_entries(spark, rules).unionByName(entries)
    entries = stored(entries.withColumn("key", key_of(F.col("kind"), F.col("host"), F.col("path"))), "listed-urls")
    shape = entries.groupBy("kind").agg(F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.when(F.col("kind") != "page", F.char_length("path"))).alias("lengths"))
    shapes = {r["kind"]: (sorted(r["labels"]), sorted(r["lengths"])) for r in shape.collect()}  # a row a kind, few distinct lengths
    n_keys = entries.count()
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not n_keys:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    blocks = max(1, -(-n_keys // BLOCK_KEYS))
    urls = split.where("host <> ''").select("host", "path").distinct()
    hits = possible_hits(url_keys(urls, shapes), bloom_filter(entries, blocks), blocks, min(blocks, n_keys))
    best = F.max_by(F.struct("rule", "verdict"), F.struct("rank", F.char_length("key").alias("long"), "key"))
    found = hits.join(sized(entries.select("key", "verdict", "rule", "rank"), n_keys, 256), "key").groupBy("host", "path").agg(best.alias("best"))
    return split.join(found, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
