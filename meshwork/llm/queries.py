"""Queries of the training-data operators and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import decontaminate, exact_dedup, filter_audit, jaccard_join, licenses, line_dedup, packing, periodic_runs, simhash, suffix_dedup, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary_path())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; a tenth of the texts, by the hash of doc_id, repeat a stretch of theirs from some word on."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.period")
    exponent = F.floor(1000 * length / period)
    return out.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_licenses": op9_licenses,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_jaccard_join": op13_jaccard_join,
}

_RULES = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}', '{r}')" for r, v in url_filter.RULES)
_JUNK = ", ".join(f"('{n}.{d}')" for n in url_filter.JUNK_NAMES for d in url_filter.EXAMPLE_DOMAINS)

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op2_url_filter": rf"""
WITH rules(h, p, v, r) AS (VALUES {_RULES}), listed(h) AS (VALUES {_JUNK}),
u AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
c AS (SELECT n, trim(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\.{{2,}}', '.', 'g'), '.') AS bare FROM u),
best AS (
  SELECT n, first(r ORDER BY length(h || p) DESC, h || p DESC) AS r, first(v ORDER BY length(h || p) DESC, h || p DESC) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n
),
junk AS (SELECT DISTINCT n FROM c JOIN listed ON bare = h OR ends_with(bare, '.' || h))
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN junk.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN best USING (n) LEFT JOIN junk USING (n)
""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents
),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, sha256(coalesce(html, '')) AS same FROM pages),
r AS (SELECT *, payload_bytes >= 1000 AND max(page_id) OVER (PARTITION BY same) <> page_id AS again, max(page_id) OVER (PARTITION BY same) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
""",
    "op6_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_TOKENS} AS t FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT row_number() OVER () AS k, item_id, {_TOKENS} AS t FROM benchmark WHERE item_id IS NOT NULL),
dt AS (SELECT n, unnest(t) AS word, unnest(range(0, len(t))) AS p FROM d),
bt AS (SELECT k, len(t) AS size, least({decontaminate.WINDOW}, len(t)) AS w, unnest(t) AS word, unnest(range(0, len(t))) AS q FROM b WHERE len(t) >= {decontaminate.MIN_TOKENS}),
laid AS (SELECT n, k, p - q AS diagonal, size, w, list(q) AS same FROM dt JOIN bt USING (word) GROUP BY ALL HAVING count(*) >= ceil(w * {decontaminate.SHARE})),
win AS (SELECT n, k, w, diagonal + s AS doc_from, len(list_filter(same, lambda q: q >= s AND q < s + w)) AS matches FROM (SELECT *, unnest(range(0, size - w + 1)) AS s FROM laid)),
best AS (SELECT doc_id, item_id, doc_from, matches, max(matches) OVER (PARTITION BY doc_id, item_id) AS top FROM win JOIN d USING (n) JOIN b USING (k) WHERE matches >= ceil(w * {decontaminate.SHARE}))
SELECT doc_id, item_id, matches::INT AS matches, min(doc_from)::INT AS doc_from FROM best WHERE matches = top GROUP BY doc_id, item_id, matches
""",
    "op7_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT n, doc, i, trim(ls[i + 1], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM d)),
b AS (SELECT n, doc, i, line, row_number() OVER (PARTITION BY n ORDER BY i) - 1 AS j FROM l WHERE line <> ''),
w AS (
  SELECT n, doc, j, k, following FROM (SELECT n, doc, j, list(line) OVER (PARTITION BY n ORDER BY j ROWS BETWEEN CURRENT ROW AND {line_dedup.RUN - 1} FOLLOWING) AS following FROM b), range(1, {line_dedup.RUN} + 1) AS t(k)
),
c AS (SELECT n, doc, j, k, following[:k] AS key FROM w WHERE len(following) >= k AND (k = {line_dedup.RUN} OR list_sum(list_transform(following[:k], lambda x: length(x))) >= {line_dedup.RUN_CHARS})),
f AS (SELECT n, j, k, {{'d': doc, 'j': j}} > min({{'d': doc, 'j': j}}) OVER (PARTITION BY key) AS again FROM c),
g AS (SELECT DISTINCT n, j + x AS j FROM f, range(0, {line_dedup.RUN}) AS t(x) WHERE again AND x < k),
gi AS (SELECT b.n, b.i FROM g JOIN b USING (n, j)),
kept AS (SELECT l0.n, count(gi.i) AS n_removed, string_agg(CASE WHEN gi.i IS NULL THEN l0.line END, chr(10) ORDER BY l0.i) AS body
  FROM (SELECT n, i, ls[i + 1] AS line FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM d)) l0 LEFT JOIN gi USING (n, i) GROUP BY l0.n),
runs AS (SELECT n, count(*) FILTER (WHERE gap IS NULL OR gap > 1) AS n_runs FROM (SELECT n, j - lag(j) OVER (PARTITION BY n ORDER BY j) AS gap FROM g) GROUP BY n)
SELECT doc_id, len(ls)::INT AS n_lines, n_removed::INT AS n_removed, coalesce(n_runs, 0)::INT AS n_runs, sha256(coalesce(body, '')) AS kept_sha256
FROM d JOIN kept USING (n) LEFT JOIN runs USING (n)
""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, doc_id, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d
),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step::INT AS step, bit, coalesce((SELECT sum(g.bit) FROM f g WHERE contains(filter_order[:step - 1], g.x)), 0)::INT AS before
  FROM o, range(1, 6) AS r(step) JOIN f ON f.x = filter_order[step]
),
k AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM k
""",
}
