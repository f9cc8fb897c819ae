"""Statistics over DataFrames: effect sizes, tests, corrections, distributions, ranking measures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import checkpointed

EPSILON = 1e-10


def normal_cdf(x: Column) -> Column:
    """The Abramowitz-Stegun approximation (fixed coefficients)."""
    z = F.abs(x) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def effect_sizes(samples: DataFrame, a: str, b: str) -> DataFrame:
    """One row for samples(method, value): Cohen's d with pooled deviation, and Glass' delta with that of b."""
    s = samples.where(F.col("method").isin(a, b))
    g = s.agg(*(f(F.when(F.col("method") == m, F.col("value"))).alias(f"{n}_{k}") for m, k in ((a, "a"), (b, "b")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("m_a") - F.col("m_b")
    return g.select(F.when(pooled == 0, 0.0).otherwise(diff / pooled).alias("cohens_d"), F.when(F.col("v_b") == 0, 0.0).otherwise(diff / F.sqrt("v_b")).alias("glass_delta"))


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt to ranges of an order, _p the number of a row's range; computed once, as both steps of `running` read it."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def running(ranges: DataFrame, order: list[Column], value: Column, name: str, fold: str = "sum", back: bool = False) -> DataFrame:
    """The sum, max or min of value over all rows up to this one (from this one on, with back), range by range.

    Each range is ordered for itself; only one number a range is carried over. order
    tells the rows of a range apart, ascending, or descending with back.
    """
    f = {"sum": F.sum, "max": F.max, "min": F.min}[fold]
    here = f(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = ranges.groupBy("_p").agg(f(value).alias("_t"))
    others = Window.orderBy(F.desc("_p") if back else F.col("_p")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_p", f("_t").over(others).alias("_b"))  # one row a range
    both = F.col("_h") + F.coalesce("_b", F.lit(0)) if fold == "sum" else (F.greatest if fold == "max" else F.least)("_h", "_b")
    return ranges.withColumn("_h", here).join(F.broadcast(before), "_p").withColumn(name, both).drop("_h", "_b")


def ranked(values: DataFrame, value: str = "value") -> DataFrame:
    """Distinct values with their count and average rank over all rows, from counts of values only."""
    return ranked_counts(values.groupBy(value).agg(F.count("*").alias("c")), value)


def ranked_counts(counts: DataFrame, value: str) -> DataFrame:
    upto = running(in_ranges(counts, F.col(value)), [F.col(value)], F.col("c"), "below_or_equal")
    return upto.select(value, "c", "below_or_equal", (F.col("below_or_equal") - (F.col("c") - 1) / 2.0).alias("rank"))


def positions(scores: DataFrame, score: str, *ties: str) -> DataFrame:
    """scores with position from 1, highest score first, the ties by further columns."""
    order = [F.desc(score), *(F.col(t) for t in ties)]
    return running(in_ranges(scores, *order), order, F.lit(1), "position").drop("_p")


def cliffs_delta(samples: DataFrame, a: str, b: str) -> DataFrame:
    """(#greater - #less) / (n1 n2), from counts of values instead of pairs; and Mann-Whitney U with its normal p."""
    s = samples.where(F.col("method").isin(a, b))
    both = s.groupBy("value").agg(F.sum((F.col("method") == a).cast("int")).alias("x"), F.sum((F.col("method") == b).cast("int")).alias("y"), F.count("*").alias("c"))
    ranks = ranked_counts(both.select("value", "c"), "value").select("value", "rank")
    sums = both.join(ranks, "value").agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum(F.col("x") * F.col("rank")).alias("r1"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return sums.select((2 * u1 / (n1 * n2) - 1).alias("cliffs_delta"), u.alias("u"), (2 * normal_cdf(-F.abs(z))).alias("p"))


def corrected(tests: DataFrame, alpha: float = 0.05, lam: float = 0.5, monotone: str = "max") -> DataFrame:
    """tests(test, p) with Bonferroni, Holm, Benjamini-Hochberg and Storey adjusted p-values.

    Storey's values run from the largest p to the smallest with a running maximum, so
    that none is below the one before; monotone="min" gives the usual minimum.
    """
    one, m = F.lit(1.0), F.col("m")
    total = tests.agg(F.count("*").alias("m"), F.least(one, F.sum((F.col("p") > lam).cast("double")) / F.count("*") / (1 - lam)).alias("pi0"))
    up, down = [F.col("p"), F.col("test")], [F.desc("p"), F.desc("test")]
    r = running(in_ranges(tests, *up), up, F.lit(1), "i").join(F.broadcast(total))  # one row is broadcast
    r = running(r, up, F.least(one, (m - F.col("i") + 1) * F.col("p")), "holm", "max")
    r = running(r, down, F.least(one, F.col("p") * m / F.col("i")), "benjamini_hochberg", "min", back=True)
    r = running(r, down, F.least(one, F.col("p") * m * F.col("pi0") / F.col("i")), "storey", monotone, back=True)
    return r.select("test", "p", F.least(one, F.col("p") * m).alias("bonferroni"), "holm", "benjamini_hochberg", "storey", (F.col("p") < alpha / m).alias("significant"))


def wilcoxon(samples: DataFrame) -> DataFrame:
    """samples(a, b): the smaller signed rank sum, differences of zero dropped, with its normal p."""
    d = samples.select((F.col("a") - F.col("b")).alias("d")).where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.sum((F.col("d") > 0).cast("int")).alias("up"))
    r = d.select("size", "up").join(ranked_counts(d.select("size", "c"), "size"), "size").agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("plus"))
    n = F.col("n")
    w = F.least("plus", n * (n + 1) / 2 - F.col("plus"))
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return r.select(F.coalesce(w, F.lit(0.0)).alias("w"), F.coalesce(2 * (1 - normal_cdf(F.abs(z))), F.lit(1.0)).alias("p"))


#: Draws that one task makes.
TASK_DRAWS = 4_000_000


def poisson_steps() -> list[float]:
    """A uniform number from the k-th of these on, counted from one, is a Poisson(1) number of k at least; ten is the largest."""
    steps, below, term = [], 0.0, math.exp(-1)
    for k in range(1, 11):
        below += term
        steps.append(below)
        term /= k
    return steps


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) number from a uniform one: how often a resample takes a row."""
    weight = F.lit(0)
    for k, below in enumerate(poisson_steps(), 1):
        weight = F.when(u >= below, k).otherwise(weight)
    return weight


def resampled(samples: DataFrame, replicates: int, seed: int) -> DataFrame:
    """method, r, and the sums of weights and of weighted values in each resample; samples: id, method, value.

    Each row draws its weight in each resample from the seed, its id and the resample's
    number: the first 52 bits of their MD5, as `draw` takes them. A batch adds up what it
    draws, so no row leaves its task once for each resample.
    """
    steps = np.array(poisson_steps())
    tails = [f":{r}".encode() for r in range(1, replicates + 1)]
    method = samples.schema["method"].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            taken = np.empty((len(batch), replicates))
            for k, head in enumerate(batch["head"]):
                start = hashlib.md5(head.encode(), usedforsecurity=False)
                parts = []
                for tail in tails:
                    one = start.copy()
                    one.update(tail)
                    parts.append(one.digest()[:8])
                u = (np.frombuffer(b"".join(parts), ">u8") >> np.uint64(12)).astype(float) / (1 << 52)
                taken[k] = np.searchsorted(steps, u, side="right")
            value, known = batch["value"].to_numpy(float, na_value=np.nan), batch["known"].to_numpy(bool)
            for name, at in batch.groupby("method", sort=False).indices.items():
                w, has = taken[at], known[at]
                yield pd.DataFrame({"method": [name] * replicates, "r": range(1, replicates + 1), "w": w.sum(axis=0).astype(np.int64), "wv": value[at][has] @ w[has], "n": has.sum()})

    head = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))
    rows = samples.where("method IS NOT NULL").select("method", head.alias("head"), F.col("value").cast("double").alias("value"), F.col("value").isNotNull().alias("known"))
    parts = max(1, -(-samples.count() * replicates // TASK_DRAWS))
    drawn = rows.repartition(parts).mapInPandas(sums, f"method {method}, r int, w long, wv double, n long")
    return drawn.groupBy("method", "r").agg(F.sum("w").alias("w"), F.when(F.sum("n") > 0, F.sum("wv")).alias("wv"))


def bootstrap(samples: DataFrame, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """method, mean, and the percentile interval of the mean over resamples; samples: id, method, value."""
    means = resampled(samples, replicates, seed).select("method", F.try_divide("wv", "w").alias("m"))
    tail = round((1 - confidence) / 2, 10)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY m)")
    ends = means.groupBy("method").agg(at(tail).alias("low"), at(1 - tail).alias("high"))
    return samples.groupBy("method").agg(F.avg("value").alias("mean")).join(ends, "method")


def bootstrap_difference(samples: DataFrame, a: str, b: str, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: difference of two methods' means, its percentile interval, and the two-sided share of resamples beyond zero."""
    two = samples.where(F.col("method").isin(a, b))
    mean = lambda m: F.try_divide(F.sum(F.when(F.col("method") == m, F.col("wv"))), F.sum(F.when(F.col("method") == m, F.col("w"))))
    gaps = resampled(two, replicates, seed).groupBy("r").agg((mean(a) - mean(b)).alias("d"))
    tail = round((1 - confidence) / 2, 10)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY d)")
    up = F.avg((F.col("d") > 0).cast("double"))
    row = gaps.agg(at(tail).alias("low"), at(1 - tail).alias("high"), (2 * F.least(up, 1 - up)).alias("p"))
    told = two.agg((F.avg(F.when(F.col("method") == a, F.col("value"))) - F.avg(F.when(F.col("method") == b, F.col("value")))).alias("difference"))
    return told.join(F.broadcast(row))  # one row each


def rank_biserial(samples: DataFrame, a: str, b: str) -> DataFrame:
    """One row: 2 (rank sum of a less the expected one) / (n1 n2), from average ranks, and what it is called."""
    r = cliffs_delta(samples, a, b)  # the same number: pairs above less pairs below, ties half each
    size = F.abs("cliffs_delta")
    name = F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    return r.select(F.col("cliffs_delta").alias("correlation"), name.alias("interpretation"))


def confidence_interval(samples: DataFrame) -> DataFrame:
    """method, mean and mean less and more 1.96 standard errors; samples: method, value."""
    s = samples.groupBy("method").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    return s.select("method", "mean", (F.col("mean") - 1.96 * F.col("se")).alias("low"), (F.col("mean") + 1.96 * F.col("se")).alias("high"))


def draw(seed: int, *columns: Column) -> Column:
    """A number from 0 to below 1 that a seed and some columns decide."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def paired(samples: DataFrame) -> DataFrame:
    """samples(a, b): paired t with its normal p, and the mean difference."""
    d = samples.select((F.col("a") - F.col("b")).alias("d")).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0)
    return d.select("mean", t.alias("t"), (2 * (1 - normal_cdf(F.abs(t)))).alias("p"))


def divergences(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row for two distributions (bin, share): KL, JS and earth mover's distance over ordered bins."""
    both = p.select("bin", F.col("share").alias("p")).join(q.select("bin", F.col("share").alias("q")), "bin", "full").na.fill(0.0, ["p", "q"])
    kl = lambda a, b: (a + EPSILON) * F.log((a + EPSILON) / (b + EPSILON))
    mid = (F.col("p") + F.col("q")) / 2
    cum = running(in_ranges(both, F.col("bin")), [F.col("bin")], F.col("p") - F.col("q"), "gap").withColumn("gap", F.abs("gap"))
    return cum.agg(F.greatest(F.lit(0.0), F.sum(kl(F.col("p"), F.col("q")))).alias("kl"), (0.5 * F.sum(kl(F.col("p"), mid)) + 0.5 * F.sum(kl(F.col("q"), mid))).alias("js"), F.sum("gap").alias("emd"))


#: Upper bounds and names of the degree classes.
DEGREE_CLASSES = ((5, "1-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1000"))
LAST_CLASS = "1000+"


def degree_class(degree: Column) -> Column:
    name = F.lit(LAST_CLASS)
    for k, n in reversed(DEGREE_CLASSES):
        name = F.when(degree <= k, n).otherwise(name)
    return name


def class_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: Jensen-Shannon divergence in bits of two sets of degrees (degree) over the degree classes, one added to each; empty sets: 1."""
    names = p.sparkSession.createDataFrame([(n,) for _, n in DEGREE_CLASSES] + [(LAST_CLASS,)], "bin string")
    counted = [x.groupBy(degree_class(F.col("degree")).alias("bin")).agg(F.count("*").alias(c)) for x, c in ((p, "p"), (q, "q"))]
    both = names.join(counted[0], "bin", "left").join(counted[1], "bin", "left").na.fill(0, ["p", "q"])
    totals = both.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    k = len(DEGREE_CLASSES) + 1
    x, y = (F.col("p") + 1) / (F.col("tp") + k), (F.col("q") + 1) / (F.col("tq") + k)
    part = (x * F.log2(2 * x / (x + y)) + y * F.log2(2 * y / (x + y))) / 2
    out = both.join(F.broadcast(totals)).agg(F.sum(part).alias("jsd"), F.min(F.least("tp", "tq")).alias("least"))  # one row is broadcast
    return out.select(F.when(F.col("least") == 0, 1.0).otherwise(F.col("jsd")).alias("jsd"))


def retrieval(rankings: DataFrame, k: int = 10) -> DataFrame:
    """query, precision, recall, average precision (over hits), reciprocal rank and NDCG of rankings(query, position, relevance)."""
    hit = F.col("relevance") > 0
    w = Window.partitionBy("query").orderBy("position")
    r = rankings.withColumn("hits", F.sum(hit.cast("int")).over(w))
    ideal = Window.partitionBy("query").orderBy(F.desc("relevance"), "position")
    r = r.withColumn("best", F.row_number().over(ideal))
    gain = lambda pos: F.col("relevance") / F.when(pos == 1, 1.0).otherwise(F.log2(pos.cast("double")))
    out = r.groupBy("query").agg(
        (F.sum((hit & (F.col("position") <= k)).cast("int")) / float(k)).alias("precision"),
        F.sum((hit & (F.col("position") <= k)).cast("int")).alias("found"),
        F.sum(hit.cast("int")).alias("relevant"),
        F.avg(F.when(hit, F.col("hits") / F.col("position"))).alias("ap"),
        F.min(F.when(hit, F.col("position"))).alias("first"),
        F.sum(F.when(F.col("position") <= k, gain(F.col("position")))).alias("dcg"),
        F.sum(F.when(F.col("best") <= k, gain(F.col("best")))).alias("idcg"),
    )
    return out.select(
        "query", "precision", F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(0.0).alias("recall"), F.coalesce("ap", F.lit(0.0)).alias("average_precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(1.0).alias("ndcg"),
    )


def spearman(ranks: DataFrame) -> DataFrame:
    """One row for ranks(a, b): 1 - 6 sum(d^2) / (n^3 - n), and 0 of fewer than two."""
    d = (F.col("a") - F.col("b")).cast("double")
    n = F.count("*").cast("double")
    return ranks.agg(F.when(n < 2, 0.0).otherwise(1 - 6 * F.sum(d * d) / (n * n * n - n)).alias("spearman"))


def mean_retrieval(rankings: DataFrame, k: int = 10) -> DataFrame:
    """One row: the means over all queries of average precision, reciprocal rank, NDCG, precision and recall."""
    m = retrieval(rankings, k)
    return m.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("average_precision", "reciprocal_rank", "ndcg", "precision", "recall")))


def kendall(scores: DataFrame) -> DataFrame:
    """ranking, tau a and tau b of scores(ranking, item, a, b): pairs of one ranking that agree less those that do not.

    Rows of one ranking with the same a and b are interchangeable, so kinds of rows are
    paired, each pair as often as its kinds come; what that counts of rows with
    themselves, or with others of their item, is taken off. Fewer than two items have
    tau a 1 and tau b 0.
    """
    named = scores.where("ranking IS NOT NULL AND item IS NOT NULL")
    sign = lambda c: F.signum(F.col(f"x.{c}") - F.col(f"y.{c}"))
    da, db, times = sign("a"), sign("b"), F.col("x.c") * F.col("y.c")
    terms = {"s": da * db, "n": F.abs(da * db), "ta": ((da == 0) & (db != 0)).cast("int"), "tb": ((db == 0) & (da != 0)).cast("int"), "pairs": F.lit(1)}

    def met(kinds: DataFrame, *keys: str) -> DataFrame:
        """Sums over ordered pairs of rows that share the keys: twice the sums over pairs, as all terms are symmetric, and rows with themselves."""
        both = kinds.alias("x").join(kinds.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
        return both.groupBy(F.col("x.ranking").alias("ranking")).agg(*(F.sum(t * times).alias(k) for k, t in terms.items()))

    kinds = checkpointed(named.groupBy("ranking", "a", "b").agg(F.count("*").alias("c")))
    again = named.groupBy("ranking", "item").agg(F.count("*").alias("k")).where("k > 1").select("ranking", "item")
    repeated = named.join(again, ["ranking", "item"]).groupBy("ranking", "item", "a", "b").agg(F.count("*").alias("c"))
    same = met(checkpointed(repeated), "ranking", "item").select("ranking", *(F.col(k).alias(f"{k}_same") for k in terms))
    # Rows of items that come once meet only themselves, which adds to `pairs` alone.
    single = named.join(again, ["ranking", "item"], "left_anti").groupBy("ranking").agg(F.count("*").alias("single"))
    c = met(kinds, "ranking").join(same, "ranking", "left").join(single, "ranking", "left").na.fill(0)
    c = c.select("ranking", *(((F.col(k) - F.col(f"{k}_same") - (F.col("single") if k == "pairs" else 0)) / 2).alias(k) for k in terms)).where("pairs > 0")
    low = F.sqrt((F.col("n") + F.col("ta")) * (F.col("n") + F.col("tb")))
    rows = scores.select("ranking").distinct().join(c, "ranking", "left")
    return rows.select("ranking", F.coalesce(F.col("s") / F.col("pairs"), F.lit(1.0)).alias("tau_a"), F.coalesce(F.when(low > 0, F.col("s") / low), F.lit(0.0)).alias("tau_b"))


def set_overlap(sample: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for two sets of ids: both, only in the sample, only in the truth, coverage, precision and F1."""
    both = sample.select("id").distinct().withColumn("x", F.lit(1)).join(truth.select("id").distinct().withColumn("y", F.lit(1)), "id", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    row = both.agg(n(x & y).alias("both"), n(x & ~y).alias("only_sample"), n(~x & y).alias("only_truth"))
    c = F.when(F.col("both") + F.col("only_truth") > 0, F.col("both") / (F.col("both") + F.col("only_truth"))).otherwise(0.0)
    p = F.when(F.col("both") + F.col("only_sample") > 0, F.col("both") / (F.col("both") + F.col("only_sample"))).otherwise(0.0)
    return row.select("both", "only_sample", "only_truth", c.alias("coverage"), p.alias("precision"), F.when(c + p > 0, 2 * c * p / (c + p)).otherwise(0.0).alias("f1"))


def community_coverage(sample: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the share of communities that the sample (id) holds a member of."""
    hit = membership.join(sample.select("id").distinct(), "id", "left_semi").agg(F.countDistinct("community").alias("hit"))
    total = membership.agg(F.countDistinct("community").alias("total"))
    return hit.join(F.broadcast(total)).select(F.when(F.col("total") > 0, F.col("hit") / F.col("total")).otherwise(0.0).alias("community_coverage"))  # one row each


def hubs(degrees: DataFrame, share: float = 0.1) -> DataFrame:
    """id of the share of vertices with the highest degrees, one at least, ties by id; degrees: id, degree."""
    n = max(1, math.ceil(degrees.count() * share))
    return positions(degrees.select("id", "degree"), "degree", "id").where(F.col("position") <= n).select("id")


def hub_coverage(paths: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """src, dst and the share of the pair's paths that touch a hub."""
    each = paths.select("src", "dst", "nodes", F.explode("nodes").alias("id")).join(hub_ids.select("id", F.lit(1).alias("hub")), "id", "left")
    per = each.groupBy("src", "dst", "nodes").agg(F.coalesce(F.max("hub"), F.lit(0)).alias("touched"))
    return per.groupBy("src", "dst").agg(F.avg("touched").alias("hub_coverage"))


def hub_avoidance(expanded: DataFrame, hub: int = 100, peripheral: int = 10) -> DataFrame:
    """run, expanded, hubs, peripheral vertices, hub rate and peripheral ratio of expanded(run, degree), by the least degree of the class."""
    least, low = F.lit(DEGREE_CLASSES[-1][0]), 1
    bounds = []
    for k, _ in DEGREE_CLASSES:
        bounds.append((k, low))
        low = k + 1
    for k, at in reversed(bounds):
        least = F.when(F.col("degree") <= k, at).otherwise(least)
    c = expanded.withColumn("least", least).groupBy("run").agg(F.count("*").alias("expanded"), F.sum((F.col("least") >= hub).cast("int")).alias("hubs"), F.sum(((F.col("least") < hub) & (F.col("least") <= peripheral)).cast("int")).alias("peripheral"))
    ratio = F.when(F.col("hubs") > 0, F.col("peripheral") / F.col("hubs")).otherwise(F.col("peripheral").cast("double"))
    return c.select("run", "expanded", "hubs", "peripheral", (F.col("hubs") / F.col("expanded")).alias("hub_rate"), ratio.alias("peripheral_ratio"))


def mean_hub_avoidance(expanded: DataFrame, hub: int = 100, peripheral: int = 10) -> DataFrame:
    """One row: means of the hub rate and the peripheral ratio over runs, and their number."""
    return hub_avoidance(expanded, hub, peripheral).agg(F.count("*").alias("runs"), F.avg("hub_rate").alias("hub_rate"), F.avg("peripheral_ratio").alias("peripheral_ratio"))


def compared_hub_avoidance(measures: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how much two runs' hub rates and peripheral ratios differ, and whether the first is better in both."""
    pick = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    rate, ratio = pick(a, "hub_rate") - pick(b, "hub_rate"), pick(a, "peripheral_ratio") - pick(b, "peripheral_ratio")
    return measures.agg(rate.alias("hub_rate"), ratio.alias("peripheral_ratio")).withColumn("better", (F.col("hub_rate") < 0) & (F.col("peripheral_ratio") > 0))


def path_coverage(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for two sets of path signatures: how many of the truth were found, as a share of it and of those found."""
    f, t = found.select("signature").distinct(), truth.select("signature").distinct()
    row = t.join(f, "signature", "left_semi").agg(F.count("*").alias("hit")).join(F.broadcast(t.agg(F.count("*").alias("truth")))).join(F.broadcast(f.agg(F.count("*").alias("found"))))  # one row each
    return row.select("hit", F.when(F.col("truth") > 0, F.col("hit") / F.col("truth")).otherwise(0.0).alias("coverage"), F.when(F.col("found") > 0, F.col("hit") / F.col("found")).otherwise(0.0).alias("precision"))


def hub_sample_coverage(sample: DataFrame, degrees: DataFrame, least: int = 10) -> DataFrame:
    """One row: the share of vertices of so many edges that the sample (id) holds."""
    h = degrees.where(F.col("degree") >= least).select("id")
    hit = h.join(sample.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("hit"))
    return hit.join(F.broadcast(h.agg(F.count("*").alias("n")))).select(F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0).alias("topic_coverage"))  # one row each


def representativeness(sample: DataFrame, truth: DataFrame, membership: DataFrame) -> DataFrame:
    """One row that compares a sample with the truth (id, degree): overlap, divergences of degrees, degree-rank correlation, communities."""
    shares = lambda d: d.groupBy(F.col("degree").alias("bin")).agg(F.count("*").alias("c")).join(F.broadcast(d.agg(F.count("*").alias("t")))).select("bin", (F.col("c") / F.col("t")).alias("share"))  # noqa: E731  # one row is broadcast
    place = lambda d, name: positions(d.select("id", "degree"), "degree", "id").select("id", F.col("position").alias(name))
    ranks = place(sample, "a").join(place(truth, "b"), "id")
    parts = [divergences(shares(truth), shares(sample)).select(F.col("kl").alias("degree_kl"), F.col("js").alias("degree_js")), spearman(ranks).withColumnRenamed("spearman", "degree_rank_correlation"), community_coverage(sample, membership)]
    out = set_overlap(sample, truth)
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out
