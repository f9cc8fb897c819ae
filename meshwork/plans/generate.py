"""Graphs made to a specification: vertices are spark.range, edges are arithmetic on it.

Whatever is random is drawn from the seed and the numbers of the vertices or of the
draws (`draw`), so any task makes its share of the same graph. Sparse random families
take draws of edges rather than a look at each pair; families of which most pairs are
edges, and those named as small examples, write out a vertex's pairs from a range.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.statistics import draw
from meshwork.graph import Graph

#: How often a copied end is followed; half of them end at each step.
FOLLOWED = 64


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False) -> Graph:
    return Graph(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *(c for c in edges.columns if c not in ("src", "dst"))), spark.range(n), directed)


def _plain(spark: SparkSession, n: int, edges: DataFrame) -> Graph:
    """Edges with the smaller end first, without loops and copies."""
    return _graph(spark, n, edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())


def _pairs(spark: SparkSession, n: int, keep: Column | None = None) -> DataFrame:
    """src < dst of all pairs that keep: each vertex writes out its own."""
    rows = spark.range(max(0, n - 1)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    return rows if keep is None else rows.where(keep)


def _int(u: Column, n: Column | int) -> Column:
    return F.floor(u * n).cast("long")


def path(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")))


def star(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.lit(0).alias("src"), F.col("id").alias("dst")))


def wheel(spark: SparkSession, n: int) -> Graph:
    """Vertex 0 joined to a cycle of the others."""
    rim = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") % (n - 1) + 1).alias("dst"))
    return _plain(spark, n, star(spark, n).edges.union(rim))


def complete(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _pairs(spark, n))


def complete_bipartite(spark: SparkSession, a: int, b: int) -> Graph:
    return _graph(spark, a + b, spark.range(a).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(a), F.lit(a + b - 1))).alias("dst")))


def grid(spark: SparkSession, rows: int, columns: int) -> Graph:
    ids = spark.range(rows * columns)
    right = ids.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = ids.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return _graph(spark, rows * columns, right.union(down))


def torus(spark: SparkSession, rows: int, columns: int) -> Graph:
    ids, r = spark.range(rows * columns), F.floor(F.col("id") / columns)
    right = ids.select(F.col("id").alias("src"), (r * columns + (F.col("id") + 1) % columns).alias("dst"))
    down = ids.select(F.col("id").alias("src"), ((F.col("id") + columns) % (rows * columns)).alias("dst"))
    return _plain(spark, rows * columns, right.union(down))


def triangulated_grid(spark: SparkSession, rows: int, columns: int) -> Graph:
    """A planar graph: the grid with one diagonal in each cell."""
    ids = spark.range((rows - 1) * columns).where(F.col("id") % columns < columns - 1)
    return _graph(spark, rows * columns, grid(spark, rows, columns).edges.union(ids.select(F.col("id").alias("src"), (F.col("id") + columns + 1).alias("dst"))))


def balanced_tree(spark: SparkSession, branching: int, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.floor((F.col("id") - 1) / branching).alias("src"), F.col("id").alias("dst")))


def random_tree(spark: SparkSession, n: int, seed: int = 42) -> Graph:
    """Each vertex hangs on an earlier one."""
    return _graph(spark, n, spark.range(1, n).select(_int(draw(seed, F.col("id")), F.col("id")).alias("src"), F.col("id").alias("dst")))


def forest(spark: SparkSession, n: int, trees: int, seed: int = 42) -> Graph:
    """Vertex v belongs to tree v mod trees and hangs on an earlier one of it."""
    row = F.floor(F.col("id") / trees)
    parent = F.col("id") % trees + trees * _int(draw(seed, F.col("id")), row)
    return _graph(spark, n, spark.range(trees, n).select(parent.alias("src"), F.col("id").alias("dst")))


def disconnected(spark: SparkSession, n: int, parts: int, seed: int = 42) -> Graph:
    """A forest whose trees have further edges inside, two rows up."""
    more = spark.range(2 * parts, n).select((F.col("id") - 2 * parts).alias("src"), F.col("id").alias("dst"))
    return _plain(spark, n, forest(spark, n, parts, seed).edges.union(more))


def connected_cyclic(spark: SparkSession, n: int, extra: int, seed: int = 42) -> Graph:
    """A random tree with further edges."""
    k = spark.range(extra)
    more = k.select(_int(draw(seed + 1, F.col("id")), n).alias("src"), _int(draw(seed + 2, F.col("id")), n).alias("dst"))
    return _plain(spark, n, random_tree(spark, n, seed).edges.union(more))


def bipartite_tree(spark: SparkSession, a: int, b: int) -> Graph:
    """A zigzag between the sides, with the rest hung on its end."""
    left = spark.range(a).select(F.col("id").alias("src"), (a + F.least("id", F.lit(b - 1))).alias("dst"))
    right = spark.range(b).select(F.least(F.col("id") + 1, F.lit(a - 1)).alias("src"), (a + F.col("id")).alias("dst"))
    return _plain(spark, a + b, left.union(right))


def bipartite_forest(spark: SparkSession, a: int, b: int, every: int = 4) -> Graph:
    """The zigzag without every few left vertices' edges."""
    return _graph(spark, a + b, bipartite_tree(spark, a, b).edges.where(F.col("src") % every > 0))


def bipartite_connected(spark: SparkSession, a: int, b: int, draws: int, seed: int = 42) -> Graph:
    """The zigzag and drawn edges between the sides."""
    more = spark.range(draws).select(_int(draw(seed, F.col("id")), a).alias("src"), (a + _int(draw(seed + 1, F.col("id")), b)).alias("dst"))
    return _plain(spark, a + b, bipartite_tree(spark, a, b).edges.union(more))


def bipartite_disconnected(spark: SparkSession, blocks: int) -> Graph:
    """Disjoint complete bipartite graphs of two and two."""
    rows = spark.range(4 * blocks).where("id % 4 < 2").select(F.col("id").alias("src"), F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    return _graph(spark, 4 * blocks, rows.select("src", (F.col("src") - F.col("src") % 4 + F.col("k")).alias("dst")))


def circulant(spark: SparkSession, n: int, steps: list[int]) -> Graph:
    """Vertex-transitive; with steps 1 to k it is 2k-edge-connected, and Eulerian."""
    rows = spark.range(n).select(F.col("id").alias("u"), F.explode(F.array(*(F.lit(s) for s in steps))).alias("s"))
    return _plain(spark, n, rows.select(F.col("u").alias("src"), ((F.col("u") + F.col("s")) % n).alias("dst")))


def hypercube(spark: SparkSession, dimension: int) -> Graph:
    n = 1 << dimension
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*(F.lit(1 << k).cast("long") for k in range(dimension)))).alias("b")).where(F.col("src").bitwiseAND(F.col("b")) == 0)
    return _graph(spark, n, rows.select("src", (F.col("src") + F.col("b")).alias("dst")))


def tournament(spark: SparkSession, n: int, seed: int = 42) -> Graph:
    """One direction for each pair."""
    down = draw(seed, F.col("src"), F.col("dst")) < 0.5
    return _graph(spark, n, _pairs(spark, n).select(F.when(down, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("dst")), True)


def random_dag(spark: SparkSession, n: int, draws: int, seed: int = 42) -> Graph:
    """Drawn edges from smaller to larger ids."""
    k = spark.range(draws)
    return Graph(_plain(spark, n, k.select(_int(draw(seed, F.col("id")), n).alias("src"), _int(draw(seed + 1, F.col("id")), n).alias("dst"))).edges, spark.range(n), True)


def draws_for(n: int, p: float) -> int:
    """How many draws of a pair leave each of all pairs drawn with probability p."""
    pairs = n * (n - 1) / 2
    return round(-pairs * math.log1p(-p))


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 42) -> Graph:
    """Each pair is an edge with probability p: so many draws of a pair as that takes, copies merged."""
    k = spark.range(draws_for(n, p))
    a, b = _int(draw(seed, F.col("id"), F.lit(0)), n), _int(draw(seed, F.col("id"), F.lit(1)), n - 1)
    return _plain(spark, n, k.select(a.alias("src"), (b + (b >= a).cast("int")).alias("dst")))


def preferential(spark: SparkSession, n: int, m: int = 2, seed: int = 42) -> Graph:
    """Each vertex sends m edges to ends of earlier edges, so to vertices in proportion to their degree.

    End 2e of edge e is its own vertex, end 2e + 1 copies an end drawn among the ones
    before. Where a copied end is itself a copy it is followed, by the same draws, so
    no step needs the edges that were made before.
    """
    copied = lambda r: _int(draw(seed, r), r)
    target = F.aggregate(F.sequence(F.lit(1), F.lit(FOLLOWED)), copied(2 * F.col("id") + 1), lambda r, _: F.when(r % 2 == 1, copied(r)).otherwise(r))
    edges = spark.range(m * (n - 1)).select((F.floor(F.col("id") / m) + 1).alias("src"), F.floor(F.floor(target / 2) / m).alias("t"))
    # The first vertex has no edge of its own: an end at the drawing vertex itself goes there.
    return _plain(spark, n, edges.select("src", F.when(F.col("t") + 1 >= F.col("src"), 0).otherwise(F.col("t") + 1).alias("dst")))


def small_world(spark: SparkSession, n: int, near: int = 2, p: float = 0.1, seed: int = 42) -> Graph:
    """A ring with so many neighbours on each side, of which the far end is drawn anew with probability p."""
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(near))).alias("s"))
    far = F.when(draw(seed, F.col("src"), F.col("s")) < p, _int(draw(seed + 1, F.col("src"), F.col("s")), n)).otherwise((F.col("src") + F.col("s")) % n)
    return _plain(spark, n, rows.select("src", far.alias("dst")))


def modular(spark: SparkSession, communities: int, size: int, inside: int, across: int, seed: int = 42) -> Graph:
    """Communities v mod communities; so many draws inside each community, and across all."""
    k = spark.range(communities * inside)
    own = F.col("id") % communities
    close = k.select((own + communities * _int(draw(seed, F.col("id")), size)).alias("src"), (own + communities * _int(draw(seed + 1, F.col("id")), size)).alias("dst"))
    far = spark.range(across).select(_int(draw(seed + 2, F.col("id")), communities * size).alias("src"), _int(draw(seed + 3, F.col("id")), communities * size).alias("dst"))
    return _plain(spark, communities * size, close.union(far))


def flow_network(spark: SparkSession, layers: int, width: int, seed: int = 42) -> Graph:
    """Source 0, layers joined one to the next, and the sink; capacities 1 to 10."""
    last = layers * width + 1
    inner = spark.range(1, (layers - 1) * width + 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(width))).alias("k")).select("src", (F.col("src") - (F.col("src") - 1) % width + width - 1 + F.col("k")).alias("dst"))
    ends = spark.range(1, width + 1).select(F.lit(0).alias("src"), F.col("id").alias("dst")).union(spark.range((layers - 1) * width + 1, last).select(F.col("id").alias("src"), F.lit(last).alias("dst")))
    return _graph(spark, last + 1, inner.union(ends).withColumn("capacity", 1 + _int(draw(seed, F.col("src"), F.col("dst")), 10)), True)


def k_path(spark: SparkSession, n: int, k: int) -> Graph:
    """Each vertex joined to the k before it: chordal, an interval graph, of tree- and pathwidth k, k-connected."""
    rows = spark.range(1, n).select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("id") - k), F.col("id") - 1)).alias("src"), F.col("id").alias("dst"))
    return _graph(spark, n, rows)


def k_colourable(spark: SparkSession, n: int, k: int, draws: int, seed: int = 42) -> Graph:
    """Draws between vertices of different remainders by k."""
    rows = spark.range(draws).select(_int(draw(seed, F.col("id")), n).alias("src"), _int(draw(seed + 1, F.col("id")), n).alias("dst"))
    return _plain(spark, n, rows.where(F.col("src") % k != F.col("dst") % k))


def split(spark: SparkSession, n: int, p: float = 0.3, seed: int = 42) -> Graph:
    """A clique of the first third; pairs of a clique vertex with another one by chance; no edges among the others."""
    c = n // 3
    return _graph(spark, n, _pairs(spark, n, (F.col("src") < c) & ((F.col("dst") < c) | (draw(seed, F.col("src"), F.col("dst")) < p))))


def cograph(spark: SparkSession, n: int) -> Graph:
    """Halves joined and put side by side in turn: the highest bit in which two ids differ tells which."""
    return _graph(spark, n, _pairs(spark, n, F.floor(F.log2(F.col("src").bitwiseXOR(F.col("dst")).cast("double"))) % 2 == 0))


def threshold(spark: SparkSession, n: int, seed: int = 42) -> Graph:
    """Each vertex joins all before it or none."""
    return _graph(spark, n, _pairs(spark, n, draw(seed, F.col("dst")) < 0.5))


def _overlapping(rows: DataFrame, width: float, around: bool) -> DataFrame:
    """src < dst of intervals (id, a, b) of at most that width that meet, on a line or on a circle of length 1.

    Intervals meet in the strips that they touch, two at most, instead of pairwise.
    """
    strips = max(1, math.floor(1 / width))
    first = F.floor(F.col("a") * strips)
    last = F.floor(F.col("b") * strips)
    touched = F.transform(F.sequence(first, last), lambda s: s % strips if around else s)
    at = rows.select("id", "a", "b", F.explode(F.array_distinct(touched)).alias("strip"))
    x, y = (at.select("strip", *(F.col(c).alias(f"{c}{k}") for c in ("id", "a", "b"))) for k in "12")
    meets = (F.col("a1") <= F.col("b2")) & (F.col("a2") <= F.col("b1"))
    if around:
        meets = meets | (F.col("b1") - 1 >= F.col("a2")) | (F.col("b2") - 1 >= F.col("a1"))
    return x.join(y, "strip").where("id1 < id2").where(meets).select(F.col("id1").alias("src"), F.col("id2").alias("dst")).distinct()


def interval(spark: SparkSession, n: int, length: float, seed: int = 42) -> Graph:
    """Drawn intervals of up to that length; those that meet are joined."""
    a = draw(seed, F.col("id"))
    return _graph(spark, n, _overlapping(spark.range(n).select("id", a.alias("a"), (a + length * draw(seed + 1, F.col("id"))).alias("b")), length, False))


def circular_arcs(spark: SparkSession, n: int, length: float, proper: bool = False, seed: int = 42) -> Graph:
    """The same on a circle; proper arcs are all of one length."""
    a = draw(seed, F.col("id"))
    b = a + length * (F.lit(1.0) if proper else draw(seed + 1, F.col("id")))
    return _graph(spark, n, _overlapping(spark.range(n).select("id", a.alias("a"), b.alias("b")), length, True))


def permutation(spark: SparkSession, n: int, seed: int = 42) -> Graph:
    """Pairs that a drawn order turns round."""
    return _graph(spark, n, _pairs(spark, n, draw(seed, F.col("src")) > draw(seed, F.col("dst"))))


def divisors(spark: SparkSession, n: int) -> Graph:
    """Comparability graph of the numbers 1 to n under division; vertex v stands for v + 1."""
    rows = spark.range(1, n // 2 + 1).select(F.col("id").alias("a"), F.explode(F.sequence(2 * F.col("id"), F.lit(n).cast("long"), F.col("id"))).alias("b"))
    return _graph(spark, n, rows.select((F.col("a") - 1).alias("src"), (F.col("b") - 1).alias("dst")))


def unit_disk(spark: SparkSession, n: int, radius: float, seed: int = 42) -> Graph:
    """Drawn points of the unit square; those no further apart than the radius are joined, found in neighbouring cells."""
    cells = max(1, math.floor(1 / radius))
    points = spark.range(n).select("id", draw(seed, F.col("id")).alias("x"), draw(seed + 1, F.col("id")).alias("y"))
    points = points.withColumns({"cx": F.floor(F.col("x") * cells), "cy": F.floor(F.col("y") * cells)})
    near = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = points.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(near).alias("c")).select("dst", "x2", "y2", "c.cx", "c.cy")
    close = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius * radius
    return _graph(spark, n, points.join(spread, ["cx", "cy"]).where("id < dst").where(close).select(F.col("id").alias("src"), "dst"))


def self_complementary(spark: SparkSession, k: int) -> Graph:
    """4k vertices in four blocks: the path of blocks joined, the two inner blocks complete."""
    block = lambda c: F.floor(F.col(c) / k)
    inner = (block("src") == block("dst")) & block("src").isin(1, 2)
    return _graph(spark, 4 * k, _pairs(spark, 4 * k, inner | (block("dst") - block("src") == 1)))


def paley(spark: SparkSession, q: int) -> Graph:
    """Residues of a prime q of remainder 1 by 4, joined where they differ by a square: strongly regular."""
    squares = sorted({x * x % q for x in range(1, q)})
    return _graph(spark, q, _pairs(spark, q, (F.col("dst") - F.col("src")).isin(squares)))


def with_chords(graph: Graph, spark: SparkSession, n: int, chords: int, seed: int = 42) -> Graph:
    """A path or cycle through all vertices and drawn chords: traceable or Hamiltonian."""
    k = spark.range(chords)
    return _plain(spark, n, graph.edges.union(k.select(_int(draw(seed, F.col("id")), n), _int(draw(seed + 1, F.col("id")), n))))


def caterpillar(spark: SparkSession, spine: int, leaves: int) -> Graph:
    """A path with so many leaves at each vertex: distance-hereditary, free of asteroidal triples, of diameter spine + 1."""
    rows = spark.range(spine).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("k"))
    return _graph(spark, spine * (leaves + 1), path(spark, spine).edges.union(rows.select("src", spine + F.col("src") * leaves + F.col("k"))))


def tadpole(spark: SparkSession, girth: int, tail: int) -> Graph:
    """A cycle with a path at its first vertex: that girth and circumference."""
    line = spark.range(tail).select(F.when(F.col("id") == 0, 0).otherwise(girth + F.col("id") - 1).alias("src"), (girth + F.col("id")).alias("dst"))
    return _graph(spark, girth + tail, cycle(spark, girth).edges.union(line))


def clique_chain(spark: SparkSession, cliques: int, k: int) -> Graph:
    """Cliques of k vertices, each sharing one with the next: a block graph, so ptolemaic."""
    n = cliques * (k - 1) + 1
    first = F.col("src") - F.col("src") % (k - 1)
    rows = spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.col("id") - F.col("id") % (k - 1) + k - 1)).alias("dst"))
    return _graph(spark, n, rows.where(F.col("dst") <= first + k - 1))


def disjoint_cliques(spark: SparkSession, cliques: int, k: int) -> Graph:
    """Independence number: the number of cliques."""
    rows = spark.range(cliques * k).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("s")).where(F.col("src") % k + F.col("s") < k)
    return _graph(spark, cliques * k, rows.select("src", (F.col("src") + F.col("s")).alias("dst")))


def star_chain(spark: SparkSession, stars: int, leaves: int) -> Graph:
    """Stars whose centres form a path: domination and vertex cover number are the number of stars."""
    return caterpillar(spark, stars, leaves)


def weighted(graph: Graph, low: float, high: float, seed: int = 42) -> Graph:
    """The same edges with a drawn weight."""
    return Graph(graph.edges.withColumn("weight", low + (high - low) * draw(seed, F.col("src"), F.col("dst"))), graph.vertices, graph.directed)


def line_graph(graph: Graph) -> Graph:
    """Edges become vertices, named by their ends; those that share an end are joined."""
    named = graph.undirected().edges.withColumn("e", F.concat_ws("-", "src", "dst"))
    ends = named.select("e", F.explode(F.array("src", "dst")).alias("at"))
    pairs = ends.select(F.col("e").alias("src"), "at").join(ends.select(F.col("e").alias("dst"), "at"), "at").where("src < dst")
    return Graph(pairs.select("src", "dst"), named.select(F.col("e").alias("id")))


def product(a: Graph, b: Graph, kind: str = "cartesian") -> Graph:
    """Pairs of vertices, named `x|y`; joined by the rule of a cartesian, tensor, strong or lexicographic product."""
    va, vb = (g.ids().select(F.col("id").cast("string").alias("id")) for g in (a, b))
    ea, eb = (g.adjacency().select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")) for g in (a, b))
    name = lambda x, y: F.concat_ws("|", x, y)
    # Every vertex, or edge, of the one takes part with every one of the other: the result has as many rows.
    beside = va.crossJoin(eb).select(name("id", "u").alias("src"), name("id", "v").alias("dst"))
    along = ea.crossJoin(vb).select(name("u", "id").alias("src"), name("v", "id").alias("dst"))
    both = ea.crossJoin(eb.withColumnsRenamed({"u": "x", "v": "y"})).select(name("u", "x").alias("src"), name("v", "y").alias("dst"))
    free = ea.crossJoin(vb.select(F.col("id").alias("x")).crossJoin(vb.select(F.col("id").alias("y")))).select(name("u", "x").alias("src"), name("v", "y").alias("dst"))
    rows = {"cartesian": beside.union(along), "tensor": both, "strong": beside.union(along).union(both), "lexicographic": beside.union(free)}[kind]
    return Graph(rows.where("src < dst").distinct(), va.crossJoin(vb.select(F.col("id").alias("y"))).select(name("id", "y").alias("id")))


def without_probes(graph: Graph, every: int = 3) -> Graph:
    """The edges of which an end at least is a probe: ids that the number does not divide."""
    return Graph(graph.edges.where((F.col("src") % every != 0) | (F.col("dst") % every != 0)), graph.vertices, graph.directed)


#: Families by the name of what they are made for.
FAMILIES: dict[str, Callable[..., Graph]] = {
    "path": path, "cycle": cycle, "star": star, "wheel": wheel, "complete": complete, "complete_bipartite": complete_bipartite, "grid": grid, "torus": torus, "planar": triangulated_grid,
    "tree": random_tree, "balanced_tree": balanced_tree, "forest": forest, "disconnected": disconnected, "connected": connected_cyclic, "bipartite_tree": bipartite_tree, "bipartite_forest": bipartite_forest,
    "bipartite": bipartite_connected, "bipartite_disconnected": bipartite_disconnected, "regular": circulant, "eulerian": circulant, "vertex_transitive": circulant, "edge_connected": circulant, "hypercube": hypercube,
    "tournament": tournament, "dag": random_dag, "random": random_graph, "scale_free": preferential, "small_world": small_world, "modular": modular, "flow": flow_network, "treewidth": k_path, "chordal": k_path,
    "vertex_connected": k_path, "pathwidth": k_path, "k_colourable": k_colourable, "split": split, "cograph": cograph, "threshold": threshold, "interval": interval, "circular_arc": circular_arcs, "permutation": permutation,
    "comparability": divisors, "unit_disk": unit_disk, "self_complementary": self_complementary, "strongly_regular": paley, "distance_hereditary": caterpillar, "girth": tadpole, "ptolemaic": clique_chain,
    "independence": disjoint_cliques, "domination": star_chain,
}


def generate(spark: SparkSession, family: str, **parameters) -> Graph:
    """A graph of a family by name, with edge weights where weight=(low, high) is asked for."""
    span = parameters.pop("weight", None)
    made = FAMILIES[family](spark, **parameters)
    return made if span is None else weighted(made, *span)


#: Property pairs that no graph has together, as (name, value, name, value, reason).
CONFLICTS = (
    ("tree", True, "connected", False, "a tree is connected"), ("tree", True, "forest", False, "a tree is a forest"), ("forest", True, "acyclic", False, "a forest has no cycle"),
    ("complete", True, "bipartite", True, "three vertices of a complete graph form a triangle"), ("complete", True, "connected", False, "a complete graph is connected"), ("bipartite", True, "triangles", True, "a triangle needs three sides"),
    ("threshold", True, "split", False, "threshold graphs are split"), ("threshold", True, "cograph", False, "threshold graphs are cographs"), ("ptolemaic", True, "chordal", False, "ptolemaic graphs are chordal"),
    ("cubic", True, "regular", False, "cubic graphs are regular"), ("strongly_regular", True, "regular", False, "strongly regular graphs are regular"), ("tournament", True, "directed", False, "a tournament has directions"), ("dag", True, "directed", False, "a directed acyclic graph has directions"),
)


def conflicts(declared: dict[str, object]) -> list[str]:
    """Why a declared combination of properties cannot be met; empty where nothing speaks against it."""
    return [why for a, x, b, y, why in CONFLICTS if declared.get(a) == x and declared.get(b) == y]
