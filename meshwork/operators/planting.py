"""Planted paths that work on vertices a graph already has: decoys, citation patterns, paths of a type template.

Vertices are drawn by number, so that every choice is a join on a number and none
needs the vertices in one place. All draws are decided by a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.statistics import draw
from meshwork.graph import Graph, checkpointed, measured, sized
from meshwork.operators import paths as P

#: Arcs of a citation path by its kind, as places among its three vertices.
ARCS = {"chain": ((0, 1), (1, 2)), "co_citation": ((1, 0), (1, 2)), "coupling": ((0, 1), (2, 1)), "author": ((0, 1), (2, 1)), "venue": ((0, 1), (2, 1))}
MEDIATED = {"author": "authored", "venue": "published"}


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows (id and others) with their number from 0 in an order, ties by id.

    Rows are dealt by range and counted by part; only those counts, one a part, are
    summed in one place.
    """
    keys = {f"_key{k}": c for k, c in enumerate(order)} | {"_id": F.col("id")}
    dealt = checkpointed(rows.withColumns(keys).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.withColumn("_place", place).join(sized(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_place")).alias("number"))


def weighted(graph: Graph, *columns: str) -> DataFrame:
    """src, dst, weight (1 where they carry none) and columns of a graph's edges."""
    return graph.edges.select("src", "dst", (F.col("weight").cast("double") if "weight" in graph.edges.columns else F.lit(1.0)).alias("weight"), *columns)


def absent(pairs: DataFrame, graph: Graph) -> DataFrame:
    """The pairs (src, dst) that are no edge of the graph; the direction counts where the graph has one."""
    old = graph.edges.select("src", "dst") if graph.directed else graph.edges.select("src", "dst").union(graph.edges.select("dst", "src"))
    return pairs.join(old.distinct(), ["src", "dst"], "left_anti")


def noise(graph: Graph, truth: DataFrame, count: int, longest: int = 4, low: float = 0.0, high: float = 0.3, seed: int = 42) -> tuple[Graph, DataFrame]:
    """The graph with decoy paths between drawn vertices, and the decoys: k, src, dst, nodes, hops.

    Each of count draws takes two vertices and a length of at most longest edges;
    inner vertices are new, numbered above the largest id (ids are whole numbers).
    Equal ends make no decoy, nor does a path of truth (column nodes) or of an
    earlier draw; either direction is the same path where the graph has none. Edges
    that exist keep their weight, new ones draw theirs from low to high. A graph of
    fewer than two vertices stays as it is.
    """
    places, (n, top) = measured(numbered(graph.ids().where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"))), F.count("*"), F.max("id"))
    spark, k = graph.edges.sparkSession, F.col("k")
    number = lambda what: F.floor(draw(seed, k, F.lit(what)) * n)
    drawn = spark.range(count if n > 1 else 0).select(F.col("id").alias("k")).select("k", number("from").alias("a"), number("to").alias("b"), (1 + F.floor(draw(seed, k, F.lit("length")) * longest)).cast("int").alias("hops")).where("a <> b")
    places = sized(places, n)
    ends = drawn.join(places.select(F.col("number").alias("a"), F.col("id").alias("src")), "a").join(places.select(F.col("number").alias("b"), F.col("id").alias("dst")), "b")
    fresh = F.transform(F.sequence(F.lit(1), F.lit(max(longest - 1, 1))), lambda i: (F.lit(top or 0) + k * (longest - 1) + i).cast("long"))
    paths = ends.select("k", "src", "dst", F.concat(F.array("src"), F.slice(fresh, F.lit(1), F.col("hops") - 1), F.array("dst")).alias("nodes"), "hops")
    sign = (lambda c: F.array_join(c.cast("array<string>"), "-")) if graph.directed else P.signature
    signed = paths.withColumn("sign", sign(F.col("nodes"))).join(truth.select(sign(F.col("nodes")).alias("sign")).distinct(), "sign", "left_anti")
    first = F.min_by(F.struct("k", "src", "dst", "nodes", "hops"), "k")
    decoys = checkpointed(signed.groupBy("sign").agg(first.alias("p")).select("p.*"))
    steps = P.path_edges(decoys).select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    new = absent(steps, graph).withColumn("weight", low + (high - low) * draw(seed, F.col("src"), F.col("dst")))
    return Graph(weighted(graph).unionByName(new), None, graph.directed), decoys


def cited(graph: Graph, works: DataFrame, kind: str, count: int, mediators: DataFrame | None = None, low: float = 0.5, high: float = 1.0, seed: int = 42) -> tuple[Graph, DataFrame]:
    """The directed graph with paths of a citation pattern, and those paths: k, nodes, relevance (mean weight).

    Works (id) are shuffled by seed, unless they bring a number of their own. A
    chain has one work cite the next and that a third, a co-citation has the middle
    one cite both others, coupling has both cite the middle one: path k takes works
    3k to 3k + 2. Through authors or venues, works k and k + 1 are tied to mediator
    k, counted round. An arc that exists is not planted again and belongs to no
    path, one that several paths ask for belongs to the first; a path counts if all
    its arcs are its own. Too few works, or no mediators, make no paths.
    """
    if kind not in ARCS:
        raise ValueError(f"unknown kind of citation path: {kind}")
    order = works.select("id", "number") if "number" in works.columns else numbered(works.select("id").distinct(), draw(seed, F.col("id")))
    if kind in MEDIATED:
        if mediators is None:
            raise ValueError(f"{kind} paths need mediators")
        between, (m,) = measured(numbered(mediators.select("id").distinct()), F.count("*"))
        near = order.select((F.col("number") - 1).alias("k"), F.col("id").alias("c"))
        pairs = order.select(F.col("number").alias("k"), F.col("id").alias("a")).where(F.col("k") < count).join(near, "k")
        turn = pairs.withColumn("number", F.col("k") % max(m, 1))
        three = turn.join(sized(between.select("number", F.col("id").alias("b")), m), "number").select("k", F.array("a", "b", "c").alias("nodes"))
    else:
        at = lambda j: F.max(F.when(F.col("number") % 3 == j, F.col("id")))
        three = order.groupBy(F.floor(F.col("number") / 3).alias("k")).agg(F.array(at(0), at(1), at(2)).alias("nodes"), F.count("*").alias("n")).where((F.col("n") == 3) & (F.col("k") < count)).select("k", "nodes")
    arcs = F.array(*(F.struct(F.get("nodes", a).alias("src"), F.get("nodes", b).alias("dst")) for a, b in ARCS[kind]))
    asked = three.select("k", "nodes", F.explode(arcs).alias("e")).select("k", "nodes", "e.*")
    owned = checkpointed(absent(asked.groupBy("src", "dst").agg(F.min(F.struct("k", "nodes")).alias("first")), Graph(graph.edges, None, True)).select("src", "dst", "first.*", (low + (high - low) * draw(seed, F.col("src"), F.col("dst"))).alias("weight")))
    made = owned.groupBy("k", "nodes").agg(F.avg("weight").alias("relevance"), F.count("*").alias("n")).where(F.col("n") == len(ARCS[kind])).drop("n")
    new = owned.select("src", "dst", "weight", F.lit(MEDIATED.get(kind, "cites")).alias("type"))
    old = weighted(graph, "type") if "type" in graph.edges.columns else weighted(graph).withColumn("type", F.lit(None).cast("string"))
    return Graph(old.unionByName(new), None, True), made


def typed(graph: Graph, types: DataFrame, template: list[str], count: int, low: float = 0.0, high: float = 1.0, seed: int = 42) -> tuple[Graph, DataFrame]:
    """The graph with paths through drawn vertices of the template's types in order, and those paths: k, src, dst, nodes, hops.

    types: id, type. A draw that meets a vertex twice makes no path, equal paths are
    made once, by their first draw; edges that exist keep their weight. A type of
    the template that no vertex has is an error.
    """
    wanted = sorted(set(template))
    kind = types.select("id", F.col("type").cast("string").alias("type")).where(F.col("type").isin(wanted)).distinct()
    order = checkpointed(numbered(kind, F.col("type")))
    spans = {r["type"]: (r["first"], r["n"]) for r in order.groupBy("type").agg(F.min("number").alias("first"), F.count("*").alias("n")).collect()}  # a row for each type of the template
    if missing := [t for t in wanted if t not in spans]:
        raise ValueError(f"no vertex has type {missing[0]}")
    rows = graph.edges.sparkSession.range(count).select(F.col("id").alias("k"))
    places = sized(order.select("number", "id"), sum(n for _, n in spans.values()))
    for j, t in enumerate(template):
        first, n = spans[t]
        rows = rows.withColumn("number", first + F.floor(draw(seed, F.col("k"), F.lit(j)) * n)).join(places.withColumnRenamed("id", f"v{j}"), "number").drop("number")
    paths = rows.select("k", F.array(*(f"v{j}" for j in range(len(template)))).alias("nodes")).where(F.size(F.array_distinct("nodes")) == len(template))
    one = paths.groupBy("nodes").agg(F.min("k").alias("k"))
    made = checkpointed(one.select("k", F.get("nodes", 0).alias("src"), F.get("nodes", len(template) - 1).alias("dst"), "nodes", F.lit(len(template) - 1).alias("hops")))
    steps = P.path_edges(made).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    if not graph.directed:
        steps = steps.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    new = absent(steps.distinct(), graph).withColumn("weight", low + (high - low) * draw(seed, F.col("src"), F.col("dst")))
    return Graph(weighted(graph).unionByName(new), None, graph.directed), made
