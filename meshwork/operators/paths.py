"""Simple paths: enumeration by bounded joins, ranking by information, diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed
from meshwork.functions.statistics import draw
from meshwork.operators.information import EPSILON
from meshwork.operators.traversal import levels


def simple_paths(graph: Graph, pairs: DataFrame, max_hops: int) -> DataFrame:
    """src, dst, nodes and hops of all simple paths of at most max_hops edges between the given pairs.

    Each step keeps only vertices from which the target can still be reached in the
    hops that are left, known from the levels around the targets.
    """
    step = checkpointed(graph.adjacency().distinct())
    back = Graph(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), None, True) if graph.directed else graph
    pairs = checkpointed(pairs.select("src", "dst").distinct())
    near = levels(back, pairs.select(F.col("dst").alias("id")).distinct(), max_hops).select(F.col("seed").alias("dst"), F.col("id").alias("v"), F.col("hops").alias("left"))
    open_paths = pairs.select("src", "dst", F.array("src").alias("nodes"), F.col("src").alias("u")).where("src <> dst")
    done: list[DataFrame] = []
    for k in range(1, max_hops + 1):
        grown = open_paths.join(step, "u").where(~F.array_contains("nodes", F.col("v"))).join(near, ["dst", "v"]).where(F.col("left") <= max_hops - k)
        open_paths = checkpointed(grown.select("src", "dst", F.concat("nodes", F.array("v")).alias("nodes"), F.col("v").alias("u")))
        done.append(open_paths.where("u = dst").select("src", "dst", "nodes", F.lit(k).alias("hops")))
        open_paths = open_paths.where("u <> dst")
    return reduce(DataFrame.union, done)


def path_edges(paths: DataFrame) -> DataFrame:
    """One row for each edge of each path: src, dst, nodes, hops, u, v with u and v in walking order."""
    ends = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v")))
    return paths.select("src", "dst", "nodes", "hops", F.explode(ends).alias("e")).select("src", "dst", "nodes", "hops", "e.*")


def scored(paths: DataFrame, information: DataFrame, length_penalty: float = 0.0) -> DataFrame:
    """Paths with the geometric mean of their edges' information; information: src < dst, mi."""
    e = path_edges(paths).withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    mi = information.select(F.col("src").alias("a"), F.col("dst").alias("b"), "mi")
    logs = e.join(mi, ["a", "b"], "left").groupBy("src", "dst", "nodes", "hops").agg(F.avg(F.log(F.coalesce("mi", F.lit(0.0)) + EPSILON)).alias("g"))
    return logs.select("src", "dst", "nodes", "hops", F.exp(F.col("g") - length_penalty * F.col("hops")).alias("score"))


def top_paths(paths: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best paths of each pair, by score, then hops, then nodes; position from 1."""
    w = Window.partitionBy("src", "dst").orderBy((F.col("score") if score is None else score).desc(), "hops", "nodes")
    return paths.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def shortest_only(paths: DataFrame) -> DataFrame:
    return paths.withColumn("least", F.min("hops").over(Window.partitionBy("src", "dst"))).where("hops = least").drop("least")


def shortest_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """src, dst, nodes and hops of all shortest paths of each pair, by walking the levels around the target."""
    step = checkpointed(graph.adjacency().distinct())
    back = Graph(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), None, True) if graph.directed else graph
    pairs = checkpointed(pairs.select("src", "dst").where("src <> dst").distinct())
    near = checkpointed(levels(back, pairs.select(F.col("dst").alias("id")).distinct()).select(F.col("seed").alias("dst"), F.col("id").alias("v"), F.col("hops").alias("left")))
    open_paths = pairs.join(near.withColumnRenamed("v", "src"), ["dst", "src"]).select("src", "dst", F.array("src").alias("nodes"), F.col("src").alias("u"), "left", F.col("left").alias("hops"))
    done = None
    while True:
        ended = open_paths.where("left = 0").select("src", "dst", "nodes", "hops")
        done = ended if done is None else done.union(ended)
        grown = open_paths.where("left > 0").withColumn("left", F.col("left") - 1).join(step, "u").join(near, ["dst", "v", "left"])
        open_paths = checkpointed(grown.select("src", "dst", F.concat("nodes", F.array("v")).alias("nodes"), F.col("v").alias("u"), "left", "hops"))
        if open_paths.isEmpty():
            return done


def by_vertices(paths: DataFrame, scores: DataFrame, how: str = "sum") -> DataFrame:
    """Paths with the sum, mean or geometric mean of their vertices' scores (id, score); a vertex without one counts zero."""
    each = paths.select("src", "dst", "nodes", "hops", F.explode("nodes").alias("id")).join(scores.select("id", F.col("score").cast("double").alias("x")), "id", "left").na.fill(0.0, ["x"])
    fold = {"sum": F.sum("x"), "mean": F.avg("x"), "geometric": F.when(F.min("x") > 0, F.exp(F.avg(F.log("x")))).otherwise(0.0)}[how]
    return each.groupBy("src", "dst", "nodes", "hops").agg(fold.alias("score"))


def by_edges(paths: DataFrame, values: DataFrame) -> DataFrame:
    """Paths with the mean of their edges' values (src < dst, value); an edge without one counts zero."""
    e = path_edges(paths).withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    named = values.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("value").cast("double").alias("x"))
    return e.join(named, ["a", "b"], "left").na.fill(0.0, ["x"]).groupBy("src", "dst", "nodes", "hops").agg(F.avg("x").alias("score"))


def by_length(paths: DataFrame) -> DataFrame:
    """Paths with 1 / (hops + 1)."""
    return paths.select("src", "dst", "nodes", "hops", (1.0 / (F.col("hops") + 1)).alias("score"))


def at_random(paths: DataFrame, seed: int = 42) -> DataFrame:
    """Paths with a number drawn from the seed and their vertices, the same in any plan."""
    return paths.select("src", "dst", "nodes", "hops", draw(seed, F.array_join("nodes", "-")).alias("score"))


def salience(paths: DataFrame) -> DataFrame:
    """id and the number of paths that hold it."""
    return paths.select(F.explode(F.array_distinct("nodes")).alias("id")).groupBy("id").agg(F.count("*").alias("paths"))


def mean_jaccard_distance(paths: DataFrame) -> DataFrame:
    """src, dst and the mean distance of the node sets of the pair's paths."""
    a = paths.select("src", "dst", F.array_sort(F.array_distinct("nodes")).alias("x"), F.col("nodes").alias("n"))
    b = paths.select("src", "dst", F.array_sort(F.array_distinct("nodes")).alias("y"), F.col("nodes").alias("m"))
    d = 1.0 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return a.join(b, ["src", "dst"]).where("n < m").groupBy("src", "dst").agg(F.avg(d).alias("distance"))


def signature(nodes: Column) -> Column:
    """The same text for a path and its reverse."""
    back = F.reverse(nodes)
    return F.array_join(F.when(F.get(nodes, 0) > F.get(back, 0), back).otherwise(nodes).cast("array<string>"), "-")


def edge_sets(paths: DataFrame) -> DataFrame:
    """paths with the distinct undirected edges of each, as texts."""
    pairs = F.zip_with(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes") - 1), lambda a, b: F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))
    return paths.withColumn("edges", F.array_distinct(pairs))


def mean_edge_jaccard_distance(paths: DataFrame) -> DataFrame:
    """src, dst and the mean distance of the edge sets of the pair's paths."""
    one = edge_sets(paths)
    a, b = one.select("src", "dst", F.col("edges").alias("x"), F.col("nodes").alias("n")), one.select("src", "dst", F.col("edges").alias("y"), F.col("nodes").alias("m"))
    d = 1.0 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return a.join(b, ["src", "dst"]).where("n < m").groupBy("src", "dst").agg(F.avg(d).alias("distance"))


def path_measures(paths: DataFrame) -> DataFrame:
    """src, dst, paths, distinct vertices and edges, and mean, deviation, least and greatest length in vertices."""
    n = F.size("nodes")
    sizes = paths.groupBy("src", "dst").agg(F.count("*").alias("paths"), F.avg(n).alias("mean_length"), F.stddev_pop(n).alias("deviation"), F.min(n).alias("least"), F.max(n).alias("greatest"))
    vertices = paths.select("src", "dst", F.explode("nodes").alias("x")).groupBy("src", "dst").agg(F.countDistinct("x").alias("vertices"))
    edges = edge_sets(paths).select("src", "dst", F.explode("edges").alias("x")).groupBy("src", "dst").agg(F.countDistinct("x").alias("edges"))
    return sizes.join(vertices, ["src", "dst"]).join(edges, ["src", "dst"])


def length_entropy(paths: DataFrame) -> DataFrame:
    """src, dst and the entropy of the lengths of the pair's paths, as a share of the most that so many lengths can have."""
    total = paths.groupBy("src", "dst").agg(F.count("*").alias("t"), F.countDistinct("hops").alias("kinds"))
    p = F.col("c") / F.col("t")
    per = paths.groupBy("src", "dst", "hops").agg(F.count("*").alias("c")).join(total, ["src", "dst"])
    return per.groupBy("src", "dst", "kinds").agg((-F.sum(p * F.log2(p))).alias("h")).select("src", "dst", F.when(F.col("kinds") > 1, F.col("h") / F.log2(F.col("kinds").cast("double"))).otherwise(0.0).alias("diversity"))


def follows(paths: DataFrame, types: DataFrame, template: list[str]) -> DataFrame:
    """Paths whose vertices have the types (id, type) of the template, in order."""
    each = paths.select("src", "dst", "nodes", "hops", F.posexplode("nodes").alias("at", "id")).join(types.select("id", F.col("type").cast("string").alias("type")), "id", "left")
    met = each.groupBy("src", "dst", "nodes", "hops").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("type", F.lit("")).alias("type")))), lambda x: x["type"]).alias("types"))
    return met.where(F.col("types") == F.array(*(F.lit(t) for t in template))).drop("types")


def disjoint_shortest(graph: Graph, pairs: DataFrame, weight: str, k: int = 3) -> DataFrame:
    """src, dst, nodes, distance and position of up to k lightest paths of one pair of ends each, no edge used twice by a pair."""
    from meshwork.operators.traversal import shortest_weighted

    done, left = None, graph.stored()
    for position in range(1, k + 1):
        found = checkpointed(shortest_weighted(left, pairs, weight).withColumn("position", F.lit(position)))
        if found.isEmpty():
            break
        done = found if done is None else done.union(found)
        used = path_edges(found.withColumn("hops", F.size("nodes") - 1)).select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).distinct()
        rest = left.edges.withColumns({"p": F.least("src", "dst"), "q": F.greatest("src", "dst")}).join(used, ["p", "q"], "left_anti").drop("p", "q")
        left = Graph(checkpointed(rest.select(left.edges.columns)), left.vertices, left.directed)
    return done


def between(graph: Graph, paths: DataFrame) -> Graph:
    """The union of the paths' vertices and edges."""
    e = path_edges(paths).select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
    return Graph(e, paths.select(F.explode("nodes").alias("id")).distinct(), graph.directed)
