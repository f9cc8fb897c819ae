"""Agglomerative clustering of a graph, in rounds that merge all reciprocal nearest neighbours at once.

The similarity of two vertices is the weight of their edge over the largest weight, one
without weights, and zero where there is no edge; distance is one less similarity.
Average and complete linkage never bring a third cluster nearer to a merged pair than
the nearer of its parts was, so clusters that are each other's nearest stay so until
they merge: merging all such pairs of a round gives the tree that merging one closest
pair after another gives. Clusters are named by their smallest vertex, and pairs in
order of distance, then of their names, so every round has a reciprocal pair.

A merge updates distances by Lance and Williams' rule, which on similarities is a
grouped sum (average) or a grouped minimum of both parts (complete); pairs without an
edge stay absent. Single linkage needs no rule: it is the minimum spanning forest,
found by Boruvka's rounds. Clusters that no edge joins are merged last, at distance one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, dropped, measured, sized
from meshwork.operators.traversal import min_labels

LINKAGES = ("average", "complete", "single")


def _pairs(graph: Graph, weight: str | None) -> tuple[DataFrame, float]:
    """a < b and s of each edge, the heaviest of parallel ones, and the largest s."""
    s = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = graph.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(s).alias("s")).where("s > 0")
    pairs, (top,) = measured(e, F.max("s"))
    return pairs, top or 1.0


def _nearest(rated: DataFrame) -> DataFrame:
    """Pairs (a, b, near) of which each is the other's nearest."""
    key = F.struct((-F.col("near")).alias("far"), "a", "b").alias("key")
    each = rated.select(F.explode(F.array("a", "b")).alias("c"), key).groupBy("c").agg(F.min("key").alias("key"))
    return each.groupBy("key").agg(F.count("*").alias("ends")).where("ends = 2").select("key.a", "key.b", (-F.col("key.far")).alias("near"))


def _renamed(pairs: DataFrame, merges: DataFrame, n: int) -> DataFrame:
    """a < b and s of pairs whose ends got new names by merges (a, b); several rows a pair where both parts had one."""
    to = lambda end: sized(merges.select(F.col("b").alias(end), F.col("a").alias(f"{end}_to")), n, 32)
    both = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"), "s").where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s")


def dendrogram(graph: Graph, linkage: str = "average", weight: str | None = None) -> DataFrame:
    """round, a < b, height and size of every merge; the merged cluster is called a. Height never falls from part to whole.

    With single linkage a and b are the ends of the edge that joins two clusters, and size is null.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    pairs, top = _pairs(graph, weight)
    sizes, (n,) = measured(graph.ids().select(F.col("id").alias("c"), F.lit(1).cast("long").alias("size")), F.count("*"))
    out = _spanning(pairs, top, sizes, n) if linkage == "single" else _agglomerated(pairs, top, sizes, n, linkage)
    merges, roots, last = out
    # What is left has no edge between: the smallest takes in the others, one after the other.
    first = roots.agg(F.min("c").alias("a"))
    rest = roots.join(F.broadcast(first)).where("c <> a").select(F.lit(last + 1).alias("round"), "a", F.col("c").alias("b"), F.lit(1.0).alias("height"), F.lit(None).cast("long").alias("size"))  # one row is broadcast
    return merges.unionByName(rest) if merges is not None else rest


def _agglomerated(pairs: DataFrame, top: float, sizes: DataFrame, n: int, linkage: str) -> tuple[DataFrame | None, DataFrame, int]:
    merges: DataFrame | None = None
    r = 0
    while True:
        end = lambda c: sized(sizes.select(F.col("c").alias(c), F.col("size").alias(f"{c}_size")), n, 32)
        rated = pairs.join(end("a"), "a").join(end("b"), "b")
        cells = F.col("a_size") * F.col("b_size") if linkage == "average" else F.lit(1)
        met = _nearest(rated.withColumn("near", F.col("s") / cells))
        height = 1 - F.col("near") / F.lit(top)
        found = met.join(end("a"), "a").join(end("b"), "b").select(F.lit(r + 1).alias("round"), "a", "b", height.alias("height"), (F.col("a_size") + F.col("b_size")).alias("size"))
        found, (k,) = measured(found, F.count("*"))
        if not k:
            return merges, sizes.select("c"), r
        r += 1
        merges = found if merges is None else merges.unionByName(found)
        renamed = _renamed(pairs, found, k)
        if linkage == "average":
            joined = renamed.groupBy("a", "b").agg(F.sum("s").alias("s"))
        else:  # a pair stays only where all its parts had an edge
            parts = sized(found.select(F.col("a").alias("c"), F.lit(2).alias("parts")), k, 32)
            joined = renamed.groupBy("a", "b").agg(F.min("s").alias("s"), F.count("*").alias("rows"))
            for c in "ab":
                joined = joined.join(parts.select(F.col("c").alias(c), F.col("parts").alias(f"{c}_parts")), c, "left")
            joined = joined.where(F.col("rows") == F.coalesce("a_parts", F.lit(1)) * F.coalesce("b_parts", F.lit(1))).select("a", "b", "s")
        before, pairs = pairs, checkpointed(joined)
        dropped(before)
        gone = sized(found.select(F.col("b").alias("c")), k, 16)
        grown = sized(found.select(F.col("a").alias("c"), F.col("size").alias("new")), k, 32)
        sizes = checkpointed(sizes.join(gone, "c", "left_anti").join(grown, "c", "left").select("c", F.coalesce("new", "size").alias("size")))


def _spanning(pairs: DataFrame, top: float, sizes: DataFrame, n: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Each round takes every cluster's nearest edge; clusters that those connect become one. a and b are the edge's own ends."""
    merges: DataFrame | None = None
    pairs = pairs.select("a", "b", F.struct((-F.col("s")).alias("far"), F.col("a").alias("u"), F.col("b").alias("v")).alias("edge"))
    r = 0
    while True:
        best = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct("edge", "a", "b").alias("key")).groupBy("c").agg(F.min("key").alias("key"))
        found, (k,) = measured(best.select("key.*").distinct(), F.count("*"))
        if not k:
            return merges, sizes.select("c"), r
        r += 1
        rows = found.select(F.lit(r).alias("round"), F.col("edge.u").alias("a"), F.col("edge.v").alias("b"), (1 + F.col("edge.far") / F.lit(top)).alias("height"), F.lit(None).cast("long").alias("size"))
        merges = rows if merges is None else merges.unionByName(rows)
        to = checkpointed(min_labels(found.select("a", "b")).select(F.col("label").alias("a"), F.col("node").alias("b")))
        pairs = checkpointed(_renamed(pairs.withColumnRenamed("edge", "s"), to, n).groupBy("a", "b").agg(F.min("s").alias("edge")))
        sizes = checkpointed(sizes.join(sized(to.select(F.col("b").alias("c")), n, 16), "c", "left_anti"))


def spanning_forest(graph: Graph) -> DataFrame:
    """src < dst of a spanning forest: of all, the one whose edges come first by their ends."""
    pairs, top = _pairs(graph, None)
    merges, _, _ = _spanning(pairs, top, graph.ids().select(F.col("id").alias("c")), graph.ids().count())
    return (merges if merges is not None else pairs.limit(0)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def clusters_at(graph: Graph, merges: DataFrame, height: float) -> DataFrame:
    """id and cluster (its smallest vertex) when the tree is cut at a height: what merges up to it connect."""
    labels = min_labels(merges.where(F.col("height") <= height).select("a", "b"))
    return graph.ids().join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))
