"""Motifs: triangles, stars, co-citation, coupling, support, trusses, small induced patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, meeting_items


def oriented(edges: DataFrame, graph: Graph) -> DataFrame:
    """Each undirected edge once, from its end of lower degree: no vertex then has many out-edges."""
    d = graph.neighbours().groupBy("u").agg(F.count("*").alias("d"))
    pairs = graph.neighbours().where("u < v").join(d, "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    swap = F.struct("d", "u") > F.struct(F.col("e"), F.col("v"))
    return pairs.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b"))


def triangles(graph: Graph) -> DataFrame:
    """a < b < c of every triangle; wedges are opened at the end of lowest degree only."""
    e = oriented(graph.edges, graph)
    wedge = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = graph.neighbours().where("u < v").select(F.col("u").alias("b"), F.col("v").alias("c"))
    found = wedge.join(closed, ["b", "c"])
    s = F.array_sort(F.array("a", "b", "c"))
    return found.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def triangle_counts(graph: Graph) -> DataFrame:
    """id, triangles, clustering of every vertex with a neighbour."""
    per = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    d = graph.neighbours().groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    joined = d.join(per, "id", "left").na.fill(0, ["triangles"])
    rate = F.when(F.col("d") > 1, 2.0 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return joined.select("id", "triangles", rate.alias("clustering"))


def stars(graph: Graph, min_degree: int) -> DataFrame:
    """hub and number of leaves of every vertex with enough distinct neighbours."""
    return graph.neighbours().groupBy(F.col("u").alias("hub")).agg(F.count("*").alias("leaves")).where(F.col("leaves") >= min_degree)


def co_citations(edges: DataFrame, min_count: int) -> DataFrame:
    """Pairs of targets that enough sources cite together."""
    return meeting_items(edges, "src", "dst").where(F.col("n") >= min_count)


def couplings(edges: DataFrame, min_shared: int) -> DataFrame:
    """Pairs of sources that share enough distinct targets."""
    return meeting_items(edges, "dst", "src", repeats=False).where(F.col("n") >= min_shared)


def support(graph: Graph) -> DataFrame:
    """u < v and the number of triangles on every edge."""
    t = triangles(graph)
    on = t.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))).alias("e"))
    n = on.groupBy("e.u", "e.v").agg(F.count("*").alias("support"))
    return graph.neighbours().where("u < v").join(n, ["u", "v"], "left").na.fill(0, ["support"])


def k_truss(graph: Graph, k: int) -> DataFrame:
    """u < v of the edges left when those on fewer than k - 2 triangles are peeled off until none is."""
    edges = checkpointed(graph.neighbours().where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst")))
    count = edges.count()
    while True:
        edges = checkpointed(support(Graph(edges)).where(F.col("support") >= k - 2).select(F.col("u").alias("src"), F.col("v").alias("dst")))
        left = edges.count()
        if left == count:
            return edges
        count = left


def induced_counts(graph: Graph) -> dict[str, int]:
    """How many induced copies there are of the connected patterns on three and four vertices.

    Copies that need not be induced follow from degrees, from triangles at vertices and
    on edges, and from shared neighbours; each is a sum over the induced patterns that
    contain it. Only triangles and pairs with a common neighbour become rows, never the
    copies of sparser patterns, of which there are far more.
    """
    near = checkpointed(graph.neighbours())
    g = Graph(checkpointed(near.where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    degree = checkpointed(near.groupBy("u").agg(F.count("*").alias("d")))
    found = checkpointed(triangles(g))
    d = F.col("d").cast("decimal(38,0)")
    total = lambda df, x: int(df.agg(F.sum(x)).first()[0] or 0)
    wedges, stars3 = total(degree, d * (d - 1)) // 2, total(degree, d * (d - 1) * (d - 2)) // 6
    k3 = found.count()
    ends = g.edges.join(degree.select(F.col("u").alias("src"), "d"), "src").join(degree.select(F.col("u").alias("dst"), F.col("d").alias("e")), "dst")
    paths = total(ends, (d - 1) * (F.col("e") - 1)) - 3 * k3
    at = found.select(F.explode(F.array("a", "b", "c")).alias("u")).join(degree, "u")
    paws = total(at, d - 2)
    on = found.select(F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "ac", "bc")))).alias("e")).groupBy("e").agg(F.count("*").alias("s"))
    two = F.expr("CAST(s * (s - 1) div 2 AS DECIMAL(38,0))")
    diamonds = total(on, two)
    fours = found.join(found.select("a", "b", F.col("c").alias("d")), ["a", "b"]).where("c < d")
    k4 = fours.join(g.edges.select(F.col("src").alias("c"), F.col("dst").alias("d")), ["c", "d"]).count()
    cycles = total(meeting_items(near, "u", "v").withColumnRenamed("n", "s"), two) // 2
    diamond = diamonds - 6 * k4
    c4 = cycles - diamond - 3 * k4
    paw = paws - 4 * diamond - 12 * k4
    return {
        "P3": wedges - 3 * k3, "K3": k3, "C3": k3, "claw": stars3 - paw - 2 * diamond - 4 * k4, "P4": paths - 4 * c4 - 2 * paw - 6 * diamond - 12 * k4,
        "C4": c4, "paw": paw, "diamond": diamond, "K4": k4,
    }


def induced_paths4(graph: Graph) -> DataFrame:
    """Number of induced paths on four vertices: a-b-c-d with no further edge."""
    return graph.edges.sparkSession.createDataFrame([(induced_counts(graph)["P4"],)], "n long")
