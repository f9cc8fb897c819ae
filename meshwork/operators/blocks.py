"""Biconnected components by a breadth-first tree: blocks are the components of a graph on the tree's edges.

Every vertex gets a preorder number and the number of vertices below it; tree edges
(named by their lower vertex) are linked where an edge beside the tree joins their
vertices, or where what lies below one reaches outside what lies below its parent.
Sweeps up and down the tree take a round for each level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed
from meshwork.operators.traversal import components, levels, min_labels


def _tree(g: Graph, near: DataFrame) -> DataFrame:
    """id, parent and hops; a component's smallest vertex is its root."""
    roots = components(g).select(F.col("component").alias("id")).distinct()
    at = checkpointed(levels(g, roots).select("id", "hops"))
    above = near.join(at.withColumnsRenamed({"id": "u", "hops": "hu"}), "u").join(at.withColumnsRenamed({"id": "v", "hops": "hv"}), "v").where("hv = hu - 1")
    parent = above.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("parent"))
    return checkpointed(at.join(parent, "id", "left"))


def _upwards(tree: DataFrame, depth: int, folds: dict) -> DataFrame:
    """tree with columns folded over all that lies below: name -> (aggregate, how a vertex joins its own)."""
    below, parts = None, []
    for h in range(depth, -1, -1):
        here = tree.where(F.col("hops") == h)
        if below is not None:
            given = below.groupBy(F.col("parent").alias("id")).agg(*(f(n).alias(f"_{n}") for n, (f, _) in folds.items()))
            here = here.join(given, "id", "left").withColumns({n: joined(F.col(n), F.coalesce(f"_{n}", F.col(n) * 0 if n == "below" else F.col(n))) for n, (_, joined) in folds.items()}).select(tree.columns)
        below = checkpointed(here)
        parts.append(below)
    return reduce(DataFrame.unionByName, parts)


def _preorder(tree: DataFrame, depth: int) -> DataFrame:
    """tree with `pre`, numbered from 0 in each component."""
    here = checkpointed(tree.where("hops = 0").withColumn("pre", F.lit(0).cast("long")))
    parts = [here]
    siblings = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for h in range(1, depth + 1):
        nxt = tree.where(F.col("hops") == h).withColumn("before", F.coalesce(F.sum("below").over(siblings), F.lit(0)))
        here = checkpointed(nxt.join(here.select(F.col("id").alias("parent"), F.col("pre").alias("top")), "parent").withColumn("pre", F.col("top") + 1 + F.col("before")).select(parts[0].columns))
        parts.append(here)
    return reduce(DataFrame.unionByName, parts)


def biconnected(graph: Graph) -> DataFrame:
    """src < dst of every undirected edge and block, the smallest id of the lower ends of its tree edges."""
    g = graph.undirected().stored()
    near = checkpointed(g.neighbours())
    tree = _tree(g, near)
    depth = tree.agg(F.max("hops")).first()[0] or 0
    sized = _upwards(tree.withColumn("below", F.lit(1).cast("long")), depth, {"below": (F.sum, lambda a, b: a + b)})
    numbered = checkpointed(_preorder(checkpointed(sized), depth))
    parents = numbered.where("parent IS NOT NULL").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), "id")
    beside = checkpointed(g.edges.join(parents.select("src", "dst"), ["src", "dst"], "left_anti"))
    reach = beside.union(beside.select("dst", "src")).toDF("id", "v").join(numbered.select(F.col("id").alias("v"), F.col("pre").alias("p")), "v").groupBy("id").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    own = numbered.join(reach, "id", "left").withColumns({"low": F.least("pre", F.coalesce("low", "pre")), "high": F.greatest("pre", F.coalesce("high", "pre"))})
    ranged = checkpointed(_upwards(checkpointed(own), depth, {"low": (F.min, F.least), "high": (F.max, F.greatest)}))
    outer = ranged.where("parent IS NOT NULL").select(F.col("id").alias("parent"), F.col("pre").alias("wp"), F.col("below").alias("wn"))
    out = ranged.join(outer, "parent").where("low < wp OR high >= wp + wn").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    labels = checkpointed(min_labels(beside.toDF("a", "b").union(out)))
    of = ranged.where("parent IS NOT NULL").select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("block"))
    on_tree = parents.join(of, "id").select("src", "dst", "block")
    # Both ends of an edge beside the tree are below tree edges of its block.
    others = beside.join(of.withColumnRenamed("id", "src"), "src").select("src", "dst", "block")
    return on_tree.union(others)


def articulation_points(blocks: DataFrame) -> DataFrame:
    """id of the vertices in several blocks, and in how many."""
    ends = blocks.select(F.explode(F.array("src", "dst")).alias("id"), "block")
    return ends.groupBy("id").agg(F.countDistinct("block").alias("blocks")).where("blocks > 1")


def bridges(blocks: DataFrame) -> DataFrame:
    """src and dst of the edges that are a block of their own."""
    alone = blocks.groupBy("block").agg(F.count("*").alias("n"), F.first("src").alias("src"), F.first("dst").alias("dst"))
    return alone.where("n = 1").select("src", "dst")
