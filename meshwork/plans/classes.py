"""Graph classes: each property as one row computed by aggregates, pattern joins or peeling loops.

Properties of the degree sequence and of small induced patterns are joins; chordal and
distance-hereditary graphs are recognised by peeling vertices in rounds. Properties
that need a search over all orders or colourings are not decided here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.statistics import in_ranges, running
from meshwork.graph import Graph, checkpointed, dropped, measured
from meshwork.operators import motifs, sweeps, traversal

#: Small graphs by name, as edges among 0, 1, 2, ...
PATTERNS: dict[str, tuple[tuple[int, int], ...]] = {
    **{f"P{n}": tuple((k, k + 1) for k in range(n - 1)) for n in range(3, 8)},
    **{f"C{n}": (*((k, k + 1) for k in range(n - 1)), (0, n - 1)) for n in range(3, 8)},
    **{f"K{n}": tuple((i, j) for j in range(n) for i in range(j)) for n in range(2, 6)},
    "claw": ((0, 1), (0, 2), (0, 3)),
    "fork": ((0, 1), (0, 2), (0, 3), (3, 4)),
    "paw": ((0, 1), (1, 2), (0, 2), (2, 3)),
    "diamond": ((0, 1), (1, 2), (2, 3), (0, 3), (0, 2)),
    "bull": ((0, 1), (1, 2), (0, 2), (0, 3), (1, 4)),
    "house": ((0, 1), (1, 2), (2, 3), (0, 3), (0, 4), (1, 4)),
    "gem": ((0, 1), (1, 2), (2, 3), (0, 4), (1, 4), (2, 4), (3, 4)),
    "dart": ((0, 1), (1, 2), (2, 3), (0, 3), (0, 2), (0, 4)),
    "kite": ((0, 1), (1, 2), (2, 3), (0, 3), (0, 2), (1, 4)),
    "banner": ((0, 1), (1, 2), (2, 3), (0, 3), (0, 4)),
    "butterfly": ((0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)),
    "domino": ((0, 1), (1, 2), (2, 3), (0, 3), (2, 4), (4, 5), (3, 5)),
    "net": ((0, 1), (1, 2), (0, 2), (0, 3), (1, 4), (2, 5)),
}


def pattern(name: str) -> tuple[tuple[int, int], ...]:
    if name not in PATTERNS:
        raise ValueError(f"no pattern is called {name}; there are {', '.join(sorted(PATTERNS))}")
    return PATTERNS[name]


def automorphisms(edges: tuple[tuple[int, int], ...]) -> int:
    """In how many ways a small pattern maps onto itself."""
    from itertools import permutations

    n, own = max(max(e) for e in edges) + 1, {frozenset(e) for e in edges}
    return sum({frozenset((p[a], p[b])) for a, b in edges} == own for p in permutations(range(n)))


def induced_copies(graph: Graph, name: str) -> DataFrame:
    """x0, x1, ... of every induced copy of a named pattern, once for each way to lay it on the copy.

    Vertices are added along the pattern's edges by joins; each one drops out where it
    repeats another or has an edge that the pattern has not.
    """
    edges = {frozenset(e) for e in pattern(name)}
    n = max(max(e) for e in edges) + 1
    near = checkpointed(graph.neighbours())
    order = [0]
    while len(order) < n:
        order.append(min(v for v in range(n) if v not in order and any(frozenset((u, v)) in edges for u in order)))
    found = near.select(F.col("u").alias("x0")).distinct()
    for k, v in enumerate(order[1:], 1):
        linked = [u for u in order[:k] if frozenset((u, v)) in edges]
        found = found.join(near.select(F.col("u").alias(f"x{linked[0]}"), F.col("v").alias(f"x{v}")), f"x{linked[0]}")
        found = found.where(reduce(lambda a, b: a & b, (F.col(f"x{v}") != F.col(f"x{u}") for u in order[:k])))
        for u in order[:k]:
            if u != linked[0]:
                pair = near.select(F.col("u").alias(f"x{u}"), F.col("v").alias(f"x{v}"))
                found = found.join(pair, [f"x{u}", f"x{v}"], "left_semi" if u in linked else "left_anti")
    return found.select(*(f"x{k}" for k in range(n)))


#: Patterns that are counted without listing their copies.
COUNTED = ("P3", "K3", "C3", "claw", "P4", "C4", "paw", "diamond", "K4")


def pattern_counts(graph: Graph, names: list[str]) -> DataFrame:
    """pattern and the number of induced copies of each."""
    g = Graph(checkpointed(graph.undirected().edges))
    counts = motifs.induced_counts(g) if set(names) & set(COUNTED) else {}
    spark = graph.edges.sparkSession

    def row(n: str) -> DataFrame:
        if n in counts:
            return spark.createDataFrame([(n, counts[n])], "pattern string, copies long")
        return induced_copies(g, n).agg((F.count("*") / automorphisms(pattern(n))).cast("long").alias("copies")).select(F.lit(n).alias("pattern"), "copies")

    return reduce(DataFrame.union, [row(n) for n in names])


def is_free_of(graph: Graph, names: list[str]) -> bool:
    """No induced copy of any of the patterns."""
    listed = [n for n in names if n not in COUNTED]
    if len(listed) < len(names):
        counts = motifs.induced_counts(graph)
        if any(counts[n] for n in names if n in COUNTED):
            return False
    return all(induced_copies(graph, n).isEmpty() for n in listed)


def is_split(graph: Graph) -> DataFrame:
    """One row: whether the degree sequence is that of a clique and an independent set (with m the last place of which the degree is its number less one at least)."""
    d = graph.ids().join(graph.neighbours().groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")), "id", "left").na.fill(0, ["d"])
    order = [F.desc("d"), F.col("id")]
    r = running(running(in_ranges(d, *order), order, F.lit(1), "i"), order, F.col("d"), "upto")
    last = r.where("d >= i - 1").agg(F.coalesce(F.max("i"), F.lit(0)).alias("m"), F.coalesce(F.max_by("upto", "i"), F.lit(0)).alias("head"))
    total = d.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("total"))
    return last.join(F.broadcast(total)).select((F.col("head") == F.col("m") * (F.col("m") - 1) + F.col("total") - F.col("head")).alias("split"))  # one row each


def is_chordal(graph: Graph) -> bool:
    """Vertices whose neighbours are all joined are taken away in rounds; a chordal graph is used up."""
    left = Graph(checkpointed(graph.undirected().edges))
    n = left.edges.count()
    while n:
        full = motifs.triangle_counts(left).join(left.degrees().select("id", "degree"), "id").where("degree = 1 OR 2 * triangles = degree * (degree - 1)").select("id")
        gone = checkpointed(full)
        edges = left.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        left = Graph(checkpointed(edges))
        before, n = n, left.edges.count()
        if n == before:
            return False
    return True


def is_distance_hereditary(graph: Graph) -> bool:
    """Leaves, and all but one of vertices with the same neighbours or the same closed neighbourhood, are taken away in rounds."""
    left = Graph(checkpointed(graph.undirected().edges))
    n = left.edges.count()
    while n:
        near = checkpointed(left.neighbours())
        closed = near.union(near.select("u", F.col("u").alias("v")).distinct())
        extra = []
        for x in (near, closed):
            signature = x.groupBy("u").agg(F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("k"), F.count("*").alias("c"))
            first = signature.groupBy("k", "c").agg(F.min("u").alias("stay"))
            extra.append(signature.join(first, ["k", "c"]).where("u <> stay").select(F.col("u").alias("id")))
        leaves = near.groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("v")).where("d = 1").select("u", "v")
        ends = leaves.join(leaves.select(F.col("u").alias("v"), F.lit(1).alias("pair")), "v", "left").where("pair IS NULL OR u > v").select(F.col("u").alias("id"))
        # One kind a round, so that what one takes away does not cost another one its reason to go.
        gone = checkpointed(ends)
        for twins in extra:
            if gone.isEmpty():
                gone = checkpointed(twins)
        edges = left.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        left = Graph(checkpointed(edges))
        before, n = n, left.edges.count()
        if n == before:
            return False
    return True


def strongly_regular(graph: Graph) -> DataFrame:
    """One row: whether all degrees, all common-neighbour counts of joined pairs and all those of other pairs agree, with k, lambda and mu.

    Other pairs without a common neighbour count with zero.
    """
    g = Graph(checkpointed(graph.undirected().edges), graph.vertices)
    near = checkpointed(g.neighbours())
    d = g.ids().join(near.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")), "id", "left").na.fill(0, ["d"]).agg(F.min("d").alias("k"), F.max("d").alias("k2"), F.count("*").alias("n"))
    joined = motifs.support(g).agg(F.min("support").alias("lambda"), F.max("support").alias("lambda2"), F.count("*").alias("m"))
    two = near.join(near.select("u", F.col("v").alias("w")), "u").where("v < w").groupBy("v", "w").agg(F.count("*").alias("c"))
    apart = two.join(near.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_anti").agg(F.min("c").alias("mu"), F.max("c").alias("mu2"), F.count("*").alias("met"))
    row = d.join(F.broadcast(joined)).join(F.broadcast(apart))  # one row each
    others = F.col("n") * (F.col("n") - 1) / 2 - F.col("m")
    mu = F.when(F.col("met") < others, 0).otherwise(F.coalesce("mu", F.lit(0)))
    same = (F.col("k") == F.col("k2")) & (F.col("lambda") == F.col("lambda2")) & (mu == F.coalesce("mu2", F.lit(0)))
    return row.select(same.alias("strongly_regular"), "k", "lambda", mu.alias("mu"))


def eccentricities(graph: Graph) -> DataFrame:
    """id and the hops to the vertex furthest from it, among those it reaches: levels from every vertex."""
    return traversal.levels(graph, graph.ids()).groupBy(F.col("seed").alias("id")).agg(F.max("hops").alias("eccentricity"))


def reach(graph: Graph) -> tuple[int, DataFrame]:
    """The number of vertices, and hops, pairs (how many are so many hops apart) and ended (of how many vertices the farthest is so far).

    A graph that a task can hold is swept by groups of sources. Of a larger one sources
    come in blocks of 64, one bit each, so a vertex holds one row for each block that
    reaches it and a round is an or over neighbours; no pair becomes a row.
    """
    sweep = sweeps.Sweep(graph, graph.ids(), "id")
    if sweep.held:
        return sweep.n, checkpointed(sweeps.reached(sweep))
    step = checkpointed(graph.adjacency().where("u <> v").select("u", "v").distinct())
    order = [F.col("id")]
    ids = running(in_ranges(graph.ids(), *order), order, F.lit(1), "at").select("id", F.floor((F.col("at") - 1) / 64).alias("block"), F.expr("shiftleft(1L, CAST((at - 1) % 64 AS INT))").alias("bits"))
    fresh, (n,) = measured(ids, F.count("*"))
    seen, told, hops = fresh, [], 0
    while True:
        hops += 1
        met = fresh.join(step, fresh.id == step.u).groupBy("block", F.col("v").alias("id")).agg(F.bit_or("bits").alias("bits"))
        both = seen.withColumnRenamed("bits", "old").join(met, ["block", "id"], "full").select("block", "id", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("bits", F.lit(0)).alias("bits"))
        both = both.select("block", "id", F.col("old").bitwiseOR(F.col("bits")).alias("all"), F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits"))
        both, (new,) = measured(both, F.sum((F.col("bits") != 0).cast("int")))
        dropped(seen)
        seen, fresh = both.select("block", "id", F.col("all").alias("bits")), both.where("bits <> 0").select("block", "id", "bits")
        if not new:
            break
        told.append(checkpointed(fresh.groupBy("block").agg(F.lit(hops).alias("hops"), F.bit_or("bits").alias("ends"), F.sum(F.bit_count("bits").cast("long")).alias("pairs"))))
    none = ids.limit(0).select("block", F.lit(0).alias("hops"), F.col("bits").alias("ends"), F.lit(0).cast("long").alias("pairs"))
    each = reduce(DataFrame.unionByName, told, none)
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    far = each.select("block", "hops", "ends", bit).where("shiftright(ends, bit) & 1 = 1").groupBy("block", "bit").agg(F.max("hops").alias("hops"))
    return n, each.select("hops", "pairs", F.lit(0).cast("long").alias("ended")).unionByName(far.select("hops", F.lit(0).cast("long").alias("pairs"), F.lit(1).cast("long").alias("ended")))


def distances_row(graph: Graph) -> DataFrame:
    """One row: diameter, radius and mean distance over the pairs that reach each other."""
    n, told = reach(graph)
    ends = told.where("ended > 0").agg(F.max("hops").alias("most"), F.min("hops").alias("least"), F.coalesce(F.sum("ended"), F.lit(0)).alias("sources"))
    mean = told.agg((F.sum(F.col("hops") * F.col("pairs")) / F.sum("pairs")).alias("mean_distance"))
    # A source that reaches nobody has no row; its farthest vertex is itself.
    some = F.lit(0 if n else None).cast("int")
    return ends.select(F.coalesce("most", some).alias("diameter"), F.when(F.col("sources") < n, some).otherwise(F.col("least")).alias("radius")).join(F.broadcast(mean))  # one row each


def girth(graph: Graph) -> DataFrame:
    """One row: length of a shortest cycle, null without one.

    From every vertex, an edge between two vertices of one level closes an odd cycle,
    and a vertex with two edges from the level before an even one.
    """
    g = Graph(checkpointed(graph.undirected().edges))
    near = checkpointed(g.neighbours())
    hops = checkpointed(traversal.levels(g, g.ids()))
    at = lambda c, k: hops.select("seed", F.col("id").alias(c), F.col("hops").alias(k))
    both = at("u", "hu").join(near, "u").join(at("v", "hv"), ["seed", "v"])
    odd = both.where("hu = hv AND u < v").agg(F.min(2 * F.col("hu") + 1).alias("odd"))
    even = both.where("hv = hu - 1").groupBy("seed", "u", "hu").agg(F.count("*").alias("c")).where("c > 1").agg(F.min(2 * F.col("hu")).alias("even"))
    return odd.join(F.broadcast(even)).select(F.least("odd", "even").alias("girth"))  # one row each


def degree_law(graph: Graph) -> DataFrame:
    """One row: slope and fit of the logarithms of degree and number of vertices, and whether they look like a power law."""
    d = graph.degrees().where("degree > 0").groupBy("degree").agg(F.count("*").alias("n"))
    x, y = F.log(F.col("degree").cast("double")), F.log(F.col("n").cast("double"))
    row = d.agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("fit"), F.count("*").alias("kinds"))
    return row.select("slope", "fit", ((F.col("kinds") >= 3) & (F.col("slope") < -1) & (F.col("fit") > 0.5)).alias("scale_free"))


def clustering_row(graph: Graph) -> DataFrame:
    """One row: mean clustering of vertices of two neighbours and more, and transitivity (closed wedges of all wedges)."""
    c = checkpointed(motifs.triangle_counts(graph).join(graph.neighbours().groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")), "id"))
    wedges = F.sum(F.col("d") * (F.col("d") - 1) / 2)
    return c.agg(F.coalesce(F.avg(F.when(F.col("d") > 1, F.col("clustering"))), F.lit(0.0)).alias("mean_clustering"), F.coalesce(F.when(wedges > 0, F.sum("triangles") / wedges), F.lit(0.0)).alias("transitivity"))


def assortativity(graph: Graph) -> DataFrame:
    """One row: correlation of the degrees at the two ends of an edge, zero where degrees do not vary."""
    d = checkpointed(graph.degrees().select("id", "degree"))
    both = graph.adjacency().join(d.select(F.col("id").alias("u"), F.col("degree").alias("x")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("y")), "v")
    return both.agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("assortativity"))


def features(graph: Graph) -> DataFrame:
    """One row of ten features of a graph's shape."""
    g = Graph(checkpointed(graph.undirected().edges), graph.vertices)
    d = g.degrees().agg(F.count("*").alias("vertices"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("degree_deviation"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.coalesce(F.nanvl(F.skewness("degree"), F.lit(0.0)), F.lit(0.0)).alias("degree_skewness"))
    m = g.edges.agg(F.count("*").alias("edges"))
    row = d.join(F.broadcast(m)).join(F.broadcast(clustering_row(g).select("mean_clustering"))).join(F.broadcast(assortativity(g)))  # one row each
    pairs = F.col("vertices") * (F.col("vertices") - 1.0) / 2
    return row.withColumn("density", F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0))


def nearest_class(points: DataFrame, training: DataFrame, columns: list[str]) -> DataFrame:
    """item, predicted and confidence of points (item, features), by the nearest centroid of the training rows (label, features).

    Features are put on the training rows' scale; confidence is one less the distance's share of all distances.
    """
    scale = training.agg(*(f(c).alias(f"{c}_{k}") for c in columns for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))))
    centre = training.groupBy("label").agg(*(F.avg(c).alias(f"{c}_c") for c in columns))
    gap = lambda c: (F.col(c) - F.col(f"{c}_c")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
    d = F.sqrt(reduce(lambda a, b: a + b, (gap(c) ** 2 for c in columns)))
    # A row a class on the one side: the classes are as few as the labels.
    each = points.join(F.broadcast(centre.join(F.broadcast(scale)))).select("item", "label", d.alias("d"))
    best = each.groupBy("item").agg(F.min(F.struct("d", "label")).alias("b"), F.sum("d").alias("t"))
    return best.select("item", F.col("b.label").alias("predicted"), F.when(F.col("t") > 0, 1 - F.col("b.d") / F.col("t")).otherwise(1.0).alias("confidence"))


def classifier_report(predictions: DataFrame) -> DataFrame:
    """label, precision, recall, F1 and support of predictions (predicted, actual)."""
    labels = predictions.select(F.explode(F.array("predicted", "actual")).alias("label"), "predicted", "actual").distinct()
    n = lambda c: F.sum(c.cast("int"))
    names = labels.select("label").distinct()
    hit = (F.col("predicted") == F.col("actual")).cast("int")
    told = predictions.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("told"), F.sum(hit).alias("hit"))
    real = predictions.groupBy(F.col("actual").alias("label")).agg(F.count("*").alias("support"))
    both = names.join(told, "label", "left").join(real, "label", "left").na.fill(0, ["told", "hit", "support"])
    p, r = F.when(F.col("told") > 0, F.col("hit") / F.col("told")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return both.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def spectral_radius(graph: Graph, rounds: int = 100, tolerance: float = 1e-9) -> float:
    """Largest eigenvalue of the adjacency by power iteration on the graph with a loop at each vertex."""
    near = checkpointed(graph.neighbours())
    x = checkpointed(near.select("u").distinct().withColumn("x", F.lit(1.0)))
    if x.isEmpty():
        return 0.0
    before = 0.0
    for _ in range(rounds):
        around = near.join(x.select(F.col("u").alias("v"), F.col("x").alias("y")), "v").groupBy("u").agg(F.sum("y").alias("s"))
        moved = checkpointed(x.join(around, "u").select("u", "x", (F.col("x") + F.col("s")).alias("z")))
        norm, dot, length = moved.agg(F.sqrt(F.sum(F.col("z") ** 2)), F.sum(F.col("x") * F.col("z")), F.sum(F.col("x") ** 2)).first()
        now = dot / length
        if abs(now - before) < tolerance:
            break
        before, x = now, moved.select("u", (F.col("z") / norm).alias("x"))
    return now - 1


def algebraic_connectivity(graph: Graph, rounds: int = 300, tolerance: float = 1e-10) -> float:
    """Second smallest eigenvalue of the Laplacian, by power iteration on its complement to twice the largest degree, without the constant part."""
    near = checkpointed(graph.neighbours())
    d = checkpointed(graph.ids().withColumnRenamed("id", "u").join(near.groupBy("u").agg(F.count("*").cast("double").alias("d")), "u", "left").na.fill(0.0, ["d"]))
    top, n = d.agg(F.max("d"), F.count("*")).first()
    if n < 2:
        return 0.0
    shift = 2 * top
    x = checkpointed(d.withColumn("x", F.pmod(F.xxhash64("u"), F.lit(1000)) / 1000.0))
    now = before = 0.0
    for _ in range(rounds):
        mean, length = x.agg(F.avg("x"), F.sqrt(F.sum(F.col("x") ** 2) - F.count("*") * F.avg("x") ** 2)).first()
        if not length:
            return 0.0
        x = x.select("u", "d", ((F.col("x") - mean) / length).alias("x"))
        around = near.join(x.select(F.col("u").alias("v"), F.col("x").alias("y")), "v").groupBy("u").agg(F.sum("y").alias("s"))
        moved = checkpointed(x.join(around, "u", "left").select("u", "d", "x", ((shift - F.col("d")) * F.col("x") + F.coalesce("s", F.lit(0.0))).alias("z")))
        now = moved.agg(F.sum(F.col("x") * F.col("z"))).first()[0]
        if abs(now - before) < tolerance:
            break
        before, x = now, moved.select("u", "d", F.col("z").alias("x"))
    return max(0.0, shift - now)


def greedy_colours(graph: Graph) -> DataFrame:
    """id and colour: in rounds, vertices that come before all uncoloured neighbours (by degree, then id) take the least colour free around them."""
    g = Graph(checkpointed(graph.undirected().edges), graph.vertices)
    near = checkpointed(g.neighbours())
    rank = checkpointed(g.ids().join(near.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")), "id", "left").na.fill(0, ["d"]))
    left, done = rank, None
    while not left.isEmpty():
        order = F.struct((-F.col("d")).alias("less"), "id")
        waiting = near.join(left.select(F.col("id").alias("v"), order.alias("o")), "v").groupBy("u").agg(F.min("o").alias("first"))
        ready = left.withColumn("o", order).join(waiting, F.col("id") == F.col("u"), "left").where("first IS NULL OR o < first").select("id", "d")
        if done is None:
            coloured = ready.select("id", F.lit(0).alias("colour"))
        else:
            around = near.join(done.select(F.col("id").alias("v"), "colour"), "v").groupBy("u").agg(F.collect_set("colour").alias("cs"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("cs")), "cs"))
            coloured = ready.join(around, F.col("id") == F.col("u"), "left").select("id", F.coalesce(free, F.lit(0)).alias("colour"))
        coloured = checkpointed(coloured)
        done = coloured if done is None else checkpointed(done.union(coloured))
        left = checkpointed(left.join(coloured.select("id"), "id", "left_anti"))
    return done if done is not None else rank.select("id", F.lit(0).alias("colour"))


def core_periphery(graph: Graph, threshold: float = 0.5, rounds: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """id, coreness and whether above the threshold: neighbours' scores summed and put on the scale of the largest until they settle."""
    near = checkpointed(graph.neighbours())
    x = near.groupBy(F.col("u").alias("id")).agg(F.count("*").cast("double").alias("x"))
    top = x.agg(F.max("x")).first()[0] or 1.0
    x = checkpointed(x.select("id", (F.col("x") / top).alias("x")))
    for _ in range(rounds):
        around = near.join(x, near.v == x.id).groupBy("u").agg(F.sum("x").alias("s"))
        top = around.agg(F.max("s")).first()[0] or 1.0
        moved = checkpointed(x.join(around, x.id == around.u).select("id", (F.col("s") / top).alias("x"), F.abs(F.col("s") / top - F.col("x")).alias("change")))
        x = moved.select("id", "x")
        if (moved.agg(F.max("change")).first()[0] or 0.0) < tolerance:
            break
    return x.select("id", F.col("x").alias("coreness"), (F.col("x") > threshold).alias("core"))
