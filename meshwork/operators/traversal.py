"""Traversal, reachability, components, distances, orders: loops of joins with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, dropped, measured, sized


def levels(graph: Graph, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, id and hops of all vertices within reach of each seed (column id of seeds)."""
    step = checkpointed(graph.adjacency().distinct())
    seen = frontier = checkpointed(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, frontier.id == step.u).select("seed", F.col("v").alias("id")).distinct()
        frontier, (n,) = measured(reached.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(depth)), F.count("*"))
        if not n:
            break
        seen = seen.union(frontier) if depth % 5 else checkpointed(seen.union(frontier))
    return seen


def ego_network(graph: Graph, seeds: DataFrame, radius: int) -> Graph:
    """The vertices within radius hops of any seed, and the edges between them."""
    return graph.induced(levels(graph, seeds, radius).select("id").distinct())


def reachable(graph: Graph, seeds: DataFrame, backward: bool = False, max_depth: int | None = None) -> Graph:
    """The vertices that arcs lead to from any seed, within max_depth of them, and the edges between them.

    Arcs are followed from src to dst, or back, also where the graph is undirected.
    Seeds (id) that the graph lacks are passed over.
    """
    here = seeds.select("id").distinct().join(graph.ids(), "id", "left_semi")
    u, v = ("dst", "src") if backward else ("src", "dst")
    return graph.induced(_reach(here, graph.edges.select(F.col(u).alias("u"), F.col(v).alias("v")).distinct(), max_depth))


def min_labels(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it reaches, of every node of an edge list (a, b) that has an edge to another.

    Larger and smaller neighbours are linked to the smallest one in turn until all
    edges are stars, in a logarithmic number of rounds. A node's smallest neighbour
    goes to its edges where all of them are few enough, so that no hub gathers.
    """
    tally = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e, now = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), *tally)
    while True:
        before, n = now, now[0]
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(sized(least, 2 * n, 48), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(sized(low, 2 * n, 48), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("x"))
        last, (e, now) = e, measured(linked.select(F.col("x.u").alias("u"), F.col("x.w").alias("v")).where("u <> v").distinct(), *tally)
        dropped(last)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def components(graph: Graph) -> DataFrame:
    """id and component, the smallest id reachable along edges in either direction."""
    labels = min_labels(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.ids().join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def strong_components(graph: Graph) -> DataFrame:
    """id and component (its smallest member) of a directed graph, by forward and backward colouring."""
    left = checkpointed(graph.ids())
    found: DataFrame | None = None
    edges = graph.edges.select("src", "dst").distinct()
    while not left.isEmpty():
        inside = checkpointed(Graph(edges, None, True).induced(left).edges)
        colour = _spread(left, inside)
        same = inside.join(colour.withColumnRenamed("id", "src").withColumnRenamed("c", "cs"), "src").join(colour.withColumnRenamed("id", "dst").withColumnRenamed("c", "cd"), "dst").where("cs = cd")
        # Within a colour, whatever reaches its smallest vertex is strongly connected to it.
        back = _reach(colour.where("id = c").select("id"), same.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        part = checkpointed(back.join(colour, "id").select("id", F.col("c").alias("component")))
        found = part if found is None else found.union(part)
        left = checkpointed(left.join(part, "id", "left_anti"))
    return found if found is not None else graph.ids().select("id", F.col("id").alias("component"))


def _spread(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest id that reaches each vertex."""
    label = checkpointed(ids.select("id", F.col("id").alias("c")))
    while True:
        least = edges.join(label, edges.src == label.id).groupBy("dst").agg(F.min("c").alias("m"))
        nxt, (changed,) = measured(label.join(least, label.id == least.dst, "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")), F.sum((F.col("c") != F.col("old")).cast("int")))
        if not changed:
            return nxt.select("id", "c")
        label = nxt.select("id", "c")


def _reach(seeds: DataFrame, steps: DataFrame, max_depth: int | None = None) -> DataFrame:
    steps = checkpointed(steps)
    seen = frontier = checkpointed(seeds)
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        frontier = checkpointed(frontier.join(steps, frontier.id == steps.u).select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = checkpointed(seen.union(frontier))
    return seen


def distances(graph: Graph, seeds: DataFrame, weight: str) -> DataFrame:
    """seed, id, the smallest sum of non-negative weights, and the parent it comes from: relaxation until none improves.

    Of equal sums the smallest parent is taken; a seed has none.
    """
    if not graph.edges.where(F.col(weight) < 0).isEmpty():
        raise ValueError("weights must not be negative")
    step = checkpointed(graph.adjacency(weight).where("u <> v").groupBy("u", "v").agg(F.min(weight).cast("double").alias("w")))
    nobody = F.lit(None).cast(seeds.schema["id"].dataType)
    best = frontier = checkpointed(seeds.select(F.col("id").alias("seed"), "id", F.lit(0.0).alias("distance"), nobody.alias("parent")))
    while not frontier.isEmpty():
        tried = frontier.join(step, frontier.id == step.u).groupBy("seed", F.col("v").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("u").alias("p"))).alias("t"))
        better = F.col("distance").isNull() | (F.col("t.d") < F.col("distance"))
        both = best.join(tried, ["seed", "id"], "full").withColumn("better", F.coalesce(better, F.lit(False)))
        both = checkpointed(both.select("seed", "id", F.when(F.col("better"), F.col("t.d")).otherwise(F.col("distance")).alias("distance"), F.when(F.col("better"), F.col("t.p")).otherwise(F.col("parent")).alias("parent"), "better"))
        best = both.drop("better")
        frontier = both.where("better").drop("better")
    return best


def walked_back(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst and nodes of the path that parents (seed, id, parent) give for each pair; pairs out of reach are absent."""
    parents = checkpointed(parents.select(F.col("seed").alias("src"), F.col("id").alias("at"), "parent"))
    open_paths = pairs.select("src", "dst", F.array("dst").alias("nodes"), F.col("dst").alias("at"))
    done = None
    while True:
        moved = checkpointed(open_paths.join(parents, ["src", "at"]))
        ended = moved.where("parent IS NULL").select("src", "dst", "nodes")
        done = ended if done is None else done.union(ended)
        open_paths = moved.where("parent IS NOT NULL").select("src", "dst", F.concat(F.array("parent"), "nodes").alias("nodes"), F.col("parent").alias("at"))
        if open_paths.isEmpty():
            return done


def shortest_weighted(graph: Graph, pairs: DataFrame, weight: str) -> DataFrame:
    """src, dst, nodes and distance of a lightest path of each pair, the ties going to smaller parents."""
    found = checkpointed(distances(graph, pairs.select(F.col("src").alias("id")).distinct(), weight))
    total = found.select(F.col("seed").alias("src"), F.col("id").alias("dst"), "distance")
    return walked_back(found, pairs).join(total, ["src", "dst"])


def topological_levels(graph: Graph) -> DataFrame:
    """id and the longest number of edges that lead to it; vertices on or behind a cycle have none."""
    edges, (m,) = measured(graph.edges.select("src", "dst").distinct(), F.count("*"))
    arrive = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("open"))
    level = graph.ids().join(arrive, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"))
    # A round is one job: what the last level's edges take from the open ones makes the next level.
    state, (n, ready) = measured(level.select("id", "open", F.when(F.col("open") == 0, 0).alias("level")), F.count("*"), F.sum((F.col("open") == 0).cast("int")))
    depth = 0
    while ready:
        last = state.where(F.col("level") == depth).select(F.col("id").alias("src"))
        taken = edges.join(sized(last, ready, 16), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("taken"))
        depth += 1
        left = F.col("open") - F.coalesce("taken", F.lit(0))
        nxt = state.join(sized(taken, min(n, m), 24), "id", "left").select("id", left.alias("open"), F.when((left == 0) & F.col("level").isNull(), depth).otherwise(F.col("level")).alias("level"))
        before, (state, (ready,)) = state, measured(nxt, F.sum((F.col("level") == depth).cast("int")))
        dropped(before)
    return state.select("id", "level")


def two_colouring(graph: Graph) -> DataFrame:
    """component and whether it can be coloured with two colours, by parity of the hops from its smallest vertex."""
    parts = components(graph)
    hops = levels(graph, parts.select(F.col("component").alias("id")).distinct())
    side = hops.select("id", F.col("seed").alias("component"), F.pmod("hops", F.lit(2)).alias("side"))
    clash = graph.edges.join(side.select(F.col("id").alias("src"), F.col("side").alias("a"), "component"), "src").join(side.select(F.col("id").alias("dst"), F.col("side").alias("b")), "dst").where("a = b").select("component").distinct()
    each = parts.select("component").distinct()
    return each.join(clash.withColumn("bad", F.lit(True)), "component", "left").select("component", F.col("bad").isNull().alias("bipartite"))


def core_numbers(graph: Graph) -> DataFrame:
    """id and core number: each vertex takes the h-index of its neighbours' numbers until none changes.

    Neighbours are counted by their number first, so that a hub holds as many rows as there are numbers.
    """
    n = checkpointed(graph.neighbours())
    core = checkpointed(n.groupBy(F.col("u").alias("id")).agg(F.count("*").cast("int").alias("core")))
    above = Window.partitionBy("u").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        around = n.join(core.select(F.col("id").alias("v"), F.col("core").alias("c")), "v").groupBy("u", "c").agg(F.count("*").alias("k"))
        h = around.withColumn("least", F.least("c", F.sum("k").over(above))).groupBy("u").agg(F.max("least").cast("int").alias("new"))
        nxt, (changed,) = measured(core.join(h, core.id == h.u).select("id", "new", "core"), F.sum((F.col("new") != F.col("core")).cast("int")))
        core = nxt.select("id", F.col("new").alias("core"))
        if not changed:
            return core


def page_rank(graph: Graph, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """id and rank: rounds until no rank changes by the tolerance; what vertices without out-edges hold is dealt to all."""
    ids = checkpointed(graph.ids())
    n = ids.count()
    step = checkpointed(graph.adjacency())
    out = checkpointed(ids.join(step.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k")), "id", "left"))
    rank = out.select("id", "k", F.lit(1.0 / max(1, n)).alias("rank"))
    lost = out.where("k IS NULL").count() / max(1, n)
    for _ in range(rounds):
        given = step.join(rank.select(F.col("id").alias("u"), (F.col("rank") / F.col("k")).alias("share")), "u").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("s"))
        fresh = F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("s", F.lit(0.0)) + lost / max(1, n))
        nxt = rank.join(given, "id", "left").select("id", "k", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("change"))
        rank, (change, lost) = measured(nxt, F.max("change"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0)))
        if change is None or change < tolerance:
            break
    return rank.select("id", "rank")


def label_propagation(graph: Graph, rounds: int = 10) -> DataFrame:
    """id and label after synchronous rounds, until none changes; the most frequent label around wins, the smallest of ties."""
    n = checkpointed(graph.neighbours())
    label = checkpointed(graph.ids().select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = n.join(label, n.v == label.id).groupBy("u", F.col("label").alias("next")).agg(F.count("*").alias("c"))
        best = votes.groupBy("u").agg(F.min(F.struct((-F.col("c")).alias("less"), "next")).alias("b"))
        nxt = label.join(best, label.id == best.u, "left").select("id", F.coalesce("b.next", "label").alias("label"), F.coalesce(F.col("b.next") != F.col("label"), F.lit(False)).alias("moved"))
        nxt, (moved,) = measured(nxt, F.sum(F.col("moved").cast("int")))
        label = nxt.select("id", "label")
        if not moved:
            break
    return label
