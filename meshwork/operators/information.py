"""Edge information: structural bases and modifiers of an edge's mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed
from meshwork.operators import motifs

EPSILON = 1e-10


def common_neighbours(graph: Graph) -> DataFrame:
    """src, dst, common, their sum of 1/ln(degree + 2), and both degrees, of every edge.

    The common neighbours of an edge's ends are the tips of its triangles, which are
    found without opening wedges at hubs.
    """
    d = checkpointed(graph.neighbours().groupBy("u").agg(F.count("*").alias("d")))
    e = graph.edges.select("src", "dst").distinct()
    side = lambda x, y, tip: F.struct(F.col(x).alias("p"), F.col(y).alias("q"), F.col(tip).alias("x"))
    tips = motifs.triangles(graph).select(F.explode(F.array(side("a", "b", "c"), side("a", "c", "b"), side("b", "c", "a"))).alias("t")).select("t.*")
    c = tips.join(d.select(F.col("u").alias("x"), F.col("d").alias("dx")), "x").groupBy("p", "q").agg(F.count("*").alias("common"), F.sum(1 / F.log(F.col("dx") + 2.0)).alias("adamic"))
    out = e.withColumns({"p": F.least("src", "dst"), "q": F.greatest("src", "dst")}).join(c, ["p", "q"], "left").drop("p", "q").na.fill(0, ["common"]).na.fill(0.0, ["adamic"])
    out = out.join(d.select(F.col("u").alias("src"), F.col("d").alias("ds")), "src", "left").join(d.select(F.col("u").alias("dst"), F.col("d").alias("dt")), "dst", "left")
    return out.na.fill(0, ["ds", "dt"])


def jaccard(f: str = "common") -> Column:
    union = F.col("ds") + F.col("dt") - F.col(f)
    return F.when(union == 0, 0.0).otherwise(F.col(f) / union)


def structural(graph: Graph) -> DataFrame:
    """src, dst and the three structural bases."""
    c = common_neighbours(graph)
    n, m = graph.ids().count(), graph.edges.count()
    density = 2.0 * m / (n * (n - 1)) if n > 1 else 0.0
    low = F.least("ds", "dt")
    adamic = F.when(low > 0, F.least(F.lit(1.0), F.col("adamic") / (low / F.log(F.lit(4.0))))).otherwise(0.0) + EPSILON
    expected = density * density
    normal = F.greatest(F.lit(EPSILON), F.least(F.lit(1.0), (jaccard() - expected) / (1 - expected)))
    return c.select("src", "dst", (jaccard() + EPSILON).alias("jaccard"), adamic.alias("adamic_adar"), normal.alias("density_normalised"))


def degree_modifiers(graph: Graph) -> DataFrame:
    """src, dst, the degree penalty and the inverse-frequency factor."""
    c = common_neighbours(graph)
    n = graph.ids().count()
    ds, dt = F.col("ds"), F.col("dt")
    idf = lambda d: F.log(F.lit(float(n)) / (d + 1) + EPSILON)
    return c.select("src", "dst", F.exp(-0.5 * (F.log(ds + 1.0) + F.log(dt + 1.0))).alias("degree_penalty"), (idf(ds) * idf(dt)).alias("idf"))


def rarity(edges: DataFrame, kind: Column) -> DataFrame:
    """src, dst and the normalised surprise of the edge's kind among all edges."""
    total = edges.agg(F.count("*").alias("total"))
    kinds = edges.groupBy(kind.alias("kind")).agg(F.count("*").alias("c"))
    p = (F.col("c") + EPSILON) / (F.col("total") + EPSILON)
    top = -F.log(F.lit(EPSILON) / (F.col("total") + EPSILON))
    return edges.withColumn("kind", kind).join(kinds, "kind").join(F.broadcast(total)).select("src", "dst", "kind", (-F.log(p) / top).alias("rarity"))  # one row is broadcast


def attribute_similarity(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """src, dst and the absolute Pearson correlation of the ends' vectors (id, values); no spread or no vector: the least value."""
    x, y = vectors.select(F.col("id").alias("src"), F.col("values").alias("x")), vectors.select(F.col("id").alias("dst"), F.col("values").alias("y"))
    pairs = edges.select("src", "dst").join(x, "src", "left").join(y, "dst", "left").select("src", "dst", F.arrays_zip("x", "y").alias("z"))
    total = lambda f: F.aggregate("z", F.lit(0.0), lambda a, v: a + f(v["x"].cast("double"), v["y"].cast("double")))
    n = F.size("z").cast("double")
    sums = pairs.select("src", "dst", n.alias("n"), total(lambda a, b: a).alias("sx"), total(lambda a, b: b).alias("sy"), total(lambda a, b: a * b).alias("sxy"), total(lambda a, b: a * a).alias("sxx"), total(lambda a, b: b * b).alias("syy"))
    spread = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    r = F.when(spread > EPSILON, F.abs(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).otherwise(0.0)
    return sums.select("src", "dst", (F.coalesce(r, F.lit(0.0)) + EPSILON).alias("mi"))


def decayed(mi: Column, time: Column, reference: Column, rate: float = 0.001) -> Column:
    """Older edges tell less."""
    return mi * F.exp(-rate * F.greatest(F.lit(0.0), reference - time))


def modified(mi: Column, sign: Column | None = None, probability: Column | None = None, same_community: Column | None = None) -> Column:
    """Negative edges count half, uncertain ones by their probability, those inside a community half as much again."""
    if sign is not None:
        mi = mi * F.when(sign < 0, 0.5).otherwise(1.0)
    if probability is not None:
        mi = mi * F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability))
    return mi if same_community is None else mi * F.when(same_community, 1.5).otherwise(1.0)


def clustering_penalty(graph: Graph) -> DataFrame:
    """src, dst and one less the larger clustering coefficient of the ends."""
    c = checkpointed(motifs.triangle_counts(graph).select("id", "clustering"))
    ends = graph.edges.select("src", "dst").join(c.select(F.col("id").alias("src"), F.col("clustering").alias("x")), "src").join(c.select(F.col("id").alias("dst"), F.col("clustering").alias("y")), "dst")
    return ends.select("src", "dst", (1 - F.greatest("x", "y") + EPSILON).alias("penalty"))
