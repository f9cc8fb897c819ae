"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A run of non-blank lines counts when it has RUN lines or RUN_CHARS characters. Every
shortest run that counts, from each first line forwards and from each last line
backwards (RUN lines at most), selects the smallest of its line hashes, the last of
ties. Equal runs select equal fingerprints, so whatever repeats is sure to share one.

1. Only the selected positions meet, by fingerprint; those found at one place end here.
2. The others are extended to the left and right to the runs that selected them.
   Extensions that agree in hashes meet; the first by (doc_id, position) is the one
   that stays. The least and the greatest text of all that meet are compared, and
   where they differ the lines themselves decide.
3. The later ones, which together make up every maximal repeated run, are deleted.

Lines are equal when identical without leading and trailing white space. Defined
results: blank lines stay and do not break a run; null and empty texts have one
blank line; rows that repeat a doc_id count as one document, of which only a later
position repeats an earlier one; doc_id is a whole number, and a null one comes after
all others; a run that does not count stays; an empty table gives no rows; `rewrite`
keeps other columns, whatever they are called, but a column that is named as one of
its results gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import BROADCAST_BYTES, once, set_aside, shared_dir, sized, stored

RUN, RUN_CHARS = 3, 30
NOBODY = (1 << 63) - 1
RESULTS = ("n_lines", "n_removed", "n_runs", "kept_text")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def full_lines(text: Column) -> Column:
    """The non-blank lines without white space around them."""
    return F.filter(F.transform(lines(text), bare), lambda x: x != "")


def doc_keys() -> list[Column]:
    """doc and body: the number a document is ordered by, and what tells rows that repeat a doc_id apart."""
    return [F.coalesce("doc_id", F.lit(NOBODY)).alias("doc"), F.xxhash64("text").alias("body")]


def line_hashes(docs: DataFrame, line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc, body and h: hash and length of each non-blank line."""
    h = F.transform(full_lines(F.col("text")), lambda x: F.struct(line_hash(x).alias("a"), F.char_length(x).alias("c")))
    return docs.select(*doc_keys(), h.alias("h")).where(F.size("h") > 0)


def window(first: Column, n: int) -> Column:
    """The run of n lines from first, with its fingerprint: position of the smallest hash, the last of ties."""
    each = [F.get("h", first + k)["a"] for k in range(n)]
    low = reduce(F.least, each) if n > 1 else each[0]
    place = reduce(lambda acc, k: F.when(each[k] == low, F.lit(k)).otherwise(acc), range(n), F.lit(0))
    return F.struct(first.alias("s"), F.lit(n).alias("n"), low.alias("fp"), place.alias("o"), F.xxhash64(*each).alias("g"))


def shortest(at: Column, step: int, run: int, chars: int) -> Column:
    """The shortest run that counts from line `at` on (step 1) or up to it (step -1); null where the text ends before."""
    out = F.lit(None)
    for n in range(run, 0, -1):
        ends = (at + step * (n - 1) >= 0) & (at + step * (n - 1) < F.size("h"))
        total = reduce(lambda a, b: a + b, (F.get("h", at + step * k)["c"] for k in range(n)))
        counts = ends if n == run else ends & (total >= chars)
        out = F.when(counts, window(at if step == 1 else at - (n - 1), n)).otherwise(out)
    return out


def runs_of(hashes: DataFrame, run: int, chars: int) -> Column:
    """All shortest runs of a text, those that both directions find once."""
    places = F.sequence(F.lit(0), F.size("h") - 1)
    both = F.concat(F.transform(places, lambda i: shortest(i, 1, run, chars)), F.transform(places, lambda i: shortest(i, -1, run, chars)))
    return F.array_distinct(F.filter(both, lambda w: w.isNotNull()))


def extensions(hashes: DataFrame, run: int, chars: int) -> DataFrame:
    """doc, body, s, n, fp, o, g of the runs whose fingerprint is found at several places."""
    fingerprint = F.transform(runs_of(hashes, run, chars), lambda w: F.struct((w["s"] + w["o"]).alias("at"), w["fp"].alias("fp")))
    selected = hashes.select("doc", F.explode(F.array_distinct(fingerprint)).alias("f"))
    place = F.struct("doc", "f.at")
    shared = selected.groupBy("f.fp").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("fp")
    shared = stored(shared, "line-fingerprints")
    each = hashes.select("doc", "body", F.explode(runs_of(hashes, run, chars)).alias("w")).select("doc", "body", "w.*")
    return each.join(sized(shared, row_bytes=24), "fp", "left_semi")


def later(runs: DataFrame, key: list[str]) -> DataFrame:
    """The runs that an earlier place has too."""
    first = runs.groupBy(*key).agg(F.min(F.struct("doc", "s")).alias("first"), F.max(F.struct("doc", "s")).alias("last")).where("first <> last").drop("last")
    first = stored(first, "line-firsts")
    return runs.join(sized(first, row_bytes=72), key).where(F.struct("doc", "s") > F.col("first")).select("doc", "body", "s", "n")


def by_document(runs: DataFrame, *columns: str) -> DataFrame:
    """One row per document with its runs, as _doc, _body and _runs."""
    return runs.groupBy(F.col("doc").alias("_doc"), F.col("body").alias("_body")).agg(F.array_sort(F.collect_set(F.struct("s", "n", *columns))).alias("_runs"))


def small(grouped: DataFrame, array: str) -> DataFrame:
    """grouped for a broadcast only where its rows and the entries of its arrays are counted and few."""
    rows, entries = grouped.agg(F.count("*"), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()
    return sized(grouped, rows, 64) if rows * 64 + entries * 32 <= BROADCAST_BYTES else grouped


def with_runs(docs: DataFrame, grouped: DataFrame, how: str) -> DataFrame:
    keyed = docs.withColumns({"_doc": F.coalesce("doc_id", F.lit(NOBODY)), "_body": F.xxhash64("text")})
    return keyed.join(small(grouped, "_runs"), ["_doc", "_body"], how)


def run_texts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with the text of their lines."""
    held = with_runs(docs.select("doc_id", "text"), stored(by_document(runs, "fp", "o", "g"), "line-runs"), "inner")
    cut = lambda ls, w: F.struct(w["s"].alias("s"), w["n"].alias("n"), w["fp"].alias("fp"), w["o"].alias("o"), w["g"].alias("g"), F.array_join(F.slice(ls, w["s"] + 1, w["n"]), "\n").alias("line_text"))
    each = once(full_lines(F.col("text")), lambda ls: F.transform("_runs", lambda w: cut(ls, w)))
    return held.select(F.col("_doc").alias("doc"), F.col("_body").alias("body"), F.explode(each).alias("w")).select("doc", "body", "w.*")


def repeated(docs: DataFrame, run: int = RUN, chars: int = RUN_CHARS, line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc, body, s and n of the runs that an earlier place has too."""
    key = ["fp", "o", "n", "g"]
    hashes = stored(line_hashes(docs, line_hash), "line-hashes")
    runs = stored(extensions(hashes, run, chars), "line-extensions")
    several = runs.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(key)
    met = stored(runs.join(sized(stored(several, "line-groups"), row_bytes=40), key, "left_semi"), "line-met")
    texts = run_texts(docs, met)
    mixed = stored(texts.groupBy(*key).agg(F.min("line_text").alias("low"), F.max("line_text").alias("high")).where("low <> high").select(key), "line-mixed")
    if mixed.isEmpty():
        return later(met, key)
    told_apart = stored(run_texts(docs, met.join(sized(mixed, row_bytes=40), key, "left_semi")), "line-texts")
    return later(met.join(sized(mixed, row_bytes=40), key, "left_anti"), key).union(later(told_apart, ["n", "line_text"])).distinct()


def rewrite(docs: DataFrame, run: int = RUN, chars: int = RUN_CHARS) -> DataFrame:
    """docs with n_lines, n_removed, n_runs and kept_text beside its columns."""
    shared_dir(docs.sparkSession)
    gone = stored(by_document(repeated(docs.select("doc_id", "text"), run, chars)), "line-repeats")
    packed, columns = set_aside(docs, ("doc_id", "text"), RESULTS)
    joined = with_runs(packed, gone, "left").withColumn("_lines", lines(F.col("text")))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("_runs", lambda w: F.sequence(w["s"], w["s"] + w["n"] - 1)))))
    none = F.array().cast("array<int>")
    filled = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: bare(F.get("_lines", i)) != "")
    joined = joined.withColumn("_places", F.coalesce(places, none))
    gone = once(filled, lambda f: F.transform("_places", lambda p: F.get(f, p)))
    joined = joined.withColumn("_gone", F.when(F.col("_runs").isNotNull(), gone).otherwise(none))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    # A deleted line that does not follow another one opens a maximal run.
    runs = F.size(F.filter("_places", lambda x, i: (i == 0) | (x > F.get("_places", i - 1) + 1)))
    text = F.when(F.size("_gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = (F.size("_lines"), F.size("_gone"), runs, text)
    kept_apart = [c for c in packed.columns if c == "set_aside"]
    return joined.select("doc_id", "text", *kept_apart, *(x.alias(name) for x, name in zip(out, RESULTS, strict=True))).select(*columns, *RESULTS)
