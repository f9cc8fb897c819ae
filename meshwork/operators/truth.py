"""Ground truth: importance of vertices, what paths deserve by it, planted and sampled paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.statistics import draw
from meshwork.graph import Graph, checkpointed
from meshwork.operators import paths as P
from meshwork.operators import traversal


def importance(graph: Graph, blend: float = 0.5) -> DataFrame:
    """id, degree and PageRank as shares of their largest, and the two mixed."""
    d = graph.degrees().select("id", F.col("degree").cast("double").alias("d"))
    both = checkpointed(d.join(traversal.page_rank(graph), "id"))
    top = both.agg(F.max("d").alias("md"), F.max("rank").alias("mr"))
    x, y = F.col("d") / F.col("md"), F.col("rank") / F.col("mr")
    return both.join(F.broadcast(top)).select("id", x.alias("by_degree"), y.alias("by_rank"), (blend * x + (1 - blend) * y).alias("combined"))  # one row is broadcast


def by_attribute(vertices: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    """id and score: a number that the vertices carry, or a default."""
    return vertices.select("id", F.coalesce(F.col(column).cast("double"), F.lit(default)).alias("score"))


def path_truth(found: DataFrame, scores: DataFrame, how: str = "mean") -> DataFrame:
    """Paths with what their vertices' importance makes of them, best first by position."""
    scored = P.by_vertices(found, scores, how)
    w = Window.partitionBy("src", "dst").orderBy(F.desc("score"), "hops", "nodes")
    return scored.withColumn("position", F.row_number().over(w))


def all_truths(found: DataFrame, graph: Graph, how: str = "mean") -> DataFrame:
    """The same by degree, by PageRank and combined, told apart by method."""
    scores = checkpointed(importance(graph))
    out = None
    for method in ("by_degree", "by_rank", "combined"):
        one = path_truth(found, scores.select("id", F.col(method).alias("score")), how).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


def salience_truth(graph: Graph, pairs: DataFrame, information: DataFrame, k: int = 10, max_hops: int = 7) -> DataFrame:
    """signature of the k best simple paths of each pair."""
    best = P.top_paths(P.scored(P.simple_paths(graph, pairs, max_hops), information), k)
    return best.select(P.signature(F.col("nodes")).alias("signature")).distinct()


def planted(graph: Graph, pairs: DataFrame, inner: int, count: int, low: float, high: float, seed: int = 42) -> tuple[Graph, DataFrame]:
    """The graph with new paths of so many new vertices between each pair, their weights drawn from a range, and those paths.

    New vertices are numbered above the largest id there is.
    """
    top = graph.ids().agg(F.max("id").alias("top"))
    rows = pairs.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")).join(F.broadcast(top))  # one row is broadcast
    # Pairs are told apart by their rank among the pairs, so that no number is given twice.
    place = F.dense_rank().over(Window.orderBy("src", "dst")) - 1  # as many rows as paths are planted
    first = F.col("top") + 1 + (place * count + F.col("k")) * inner
    nodes = F.concat(F.array("src"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(inner - 1).cast("long")), lambda i: F.col("first") + i), F.array("dst"))
    made = checkpointed(rows.withColumn("first", first.cast("long")).select("src", "dst", nodes.alias("nodes"), F.lit(inner + 1).alias("hops")))
    steps = P.path_edges(made).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    fresh = steps.withColumn("weight", low + (high - low) * draw(seed, F.col("src"), F.col("dst")))
    old = graph.edges.select("src", "dst", (F.col("weight").cast("double") if "weight" in graph.edges.columns else F.lit(1.0)).alias("weight"))
    return Graph(old.unionByName(fresh), None, graph.directed), made


def typed_paths(graph: Graph, types: DataFrame, template: list[str]) -> DataFrame:
    """nodes of the simple paths whose vertices have the template's types in order: one join a step, each filtered by its type."""
    kind = types.select("id", F.col("type").cast("string").alias("type"))
    step = checkpointed(graph.adjacency().distinct())
    found = kind.where(F.col("type") == template[0]).select(F.array("id").alias("nodes"), F.col("id").alias("u"))
    for t in template[1:]:
        grown = found.join(step, "u").where(~F.array_contains("nodes", F.col("v"))).join(kind.where(F.col("type") == t).select(F.col("id").alias("v")), "v", "left_semi")
        found = checkpointed(grown.select(F.concat("nodes", F.array("v")).alias("nodes"), F.col("v").alias("u")))
    return found.select("nodes")


def sampled_paths(graph: Graph, pairs: DataFrame, walks: int = 10, max_hops: int = 20, seed: int = 42) -> DataFrame:
    """src, dst, walk, nodes and hops of walks that never turn back to a vertex and reach the target within so many steps.

    All walks of all pairs step together; each takes the neighbour with its smallest draw.
    """
    step = checkpointed(graph.adjacency().where("u <> v").distinct())
    at = checkpointed(pairs.where("src <> dst").select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.array("src").alias("nodes"), F.col("src").alias("u")))
    done = None
    for hop in range(1, max_hops + 1):
        luck: Column = draw(seed, F.col("src"), F.col("dst"), F.col("walk"), F.lit(hop), F.col("v"))
        tried = at.join(step, "u").where(~F.array_contains("nodes", F.col("v")))
        moved = tried.groupBy("src", "dst", "walk", "nodes").agg(F.min_by("v", F.struct(luck.alias("x"), "v")).alias("u"))
        moved = checkpointed(moved.select("src", "dst", "walk", F.concat("nodes", F.array("u")).alias("nodes"), "u"))
        ended = moved.where("u = dst").select("src", "dst", "walk", "nodes", F.lit(hop).alias("hops"))
        done = ended if done is None else done.union(ended)
        at = moved.where("u <> dst")
        if at.isEmpty():
            break
    return done
