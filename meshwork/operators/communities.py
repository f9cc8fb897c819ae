"""Community detection and the quality of a division. membership: id, community.

An edge counts with its weight where the edges have a column of that name given, and
one otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, looped, measured, sized
from meshwork.operators.traversal import components


def weighed(graph: Graph, weight: str | None) -> DataFrame:
    """src, dst, w."""
    return graph.edges.select("src", "dst", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))


def _with_ends(edges: DataFrame, membership: DataFrame) -> DataFrame:
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    return edges.join(a, "src").join(b, "dst")


def community_modularity(graph: Graph, membership: DataFrame, weight: str | None = None) -> DataFrame:
    """community and its share of the modularity: the part of all edges inside, less what the degrees lead to expect."""
    e = weighed(graph, weight)
    total = e.agg(F.sum("w").alias("m"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "w").join(membership, "id").groupBy("community").agg(F.sum("w").alias("k"))
    inside = _with_ends(e, membership).where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inside"))
    both = membership.select("community").distinct().join(ends, "community", "left").join(inside, "community", "left").na.fill(0.0, ["k", "inside"])
    return both.join(F.broadcast(total)).select("community", (F.col("inside") / F.col("m") - F.col("k") * F.col("k") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row is broadcast


def modularity(graph: Graph, membership: DataFrame, weight: str | None = None) -> DataFrame:
    """One row with Q, the sum of the communities' shares."""
    return community_modularity(graph, membership, weight).agg(F.sum("modularity").alias("modularity"))


def move_gain(links: Column, degree: Column, total: Column, inside: Column, m: Column) -> Column:
    """What Q changes by when a vertex with so many links joins a community of that total degree and inner weight (twice)."""
    joined = (inside + links) / (2 * m) - ((total + degree) / (2 * m)) ** 2
    apart = inside / (2 * m) - (total / (2 * m)) ** 2 - (degree / (2 * m)) ** 2
    return joined - apart


def neighbour_gains(graph: Graph, membership: DataFrame, weight: str | None = None) -> DataFrame:
    """id, community and gain: what Q gains when a vertex joins a community around it that is not its own."""
    e = weighed(graph, weight)
    m = e.agg(F.sum("w").alias("m"))
    step = Graph(e).adjacency("w")
    degree = step.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    named = membership.select("id", "community")
    total = degree.join(named, "id").groupBy("community").agg(F.sum("k").alias("tot"))
    inside = _with_ends(e, named).where("ca = cb").groupBy(F.col("ca").alias("community")).agg((2 * F.sum("w")).alias("inside"))
    links = step.join(named.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id"), "community").agg(F.sum("w").alias("links"))
    own = named.withColumnRenamed("community", "own")
    tried = links.join(own, "id").where("community <> own").join(degree, "id").join(total, "community").join(inside, "community", "left").na.fill(0.0, ["inside"])
    return tried.join(F.broadcast(m)).select("id", "community", move_gain(F.col("links"), F.col("k"), F.col("tot"), F.col("inside"), F.col("m")).alias("gain"))  # one row is broadcast


def quality(graph: Graph, membership: DataFrame) -> DataFrame:
    """community, size, inside, cut, volume, density and conductance."""
    total = graph.edges.agg((2 * F.count("*")).alias("total"))
    e = _with_ends(graph.edges.select("src", "dst"), membership)
    ends = e.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("within"))
    counts = ends.groupBy("community").agg(F.sum(F.col("within").cast("int")).alias("inside"), F.sum((~F.col("within")).cast("int")).alias("cut"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    out = sizes.join(counts, "community", "left").na.fill(0, ["inside", "cut"]).withColumn("volume", 2 * F.col("inside") + F.col("cut")).join(F.broadcast(total))  # one row is broadcast
    low = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    density = F.when(F.col("size") > 1, 2.0 * F.col("inside") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return out.withColumn("density", density).withColumn("conductance", F.when(low > 0, F.least(F.lit(1.0), F.col("cut") / low)).otherwise(0.0)).drop("total")


def coverage(graph: Graph, membership: DataFrame) -> DataFrame:
    return _with_ends(graph.edges.select("src", "dst"), membership).agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("coverage"))


def summary(graph: Graph, membership: DataFrame) -> DataFrame:
    """One row: modularity, average and size-weighted conductance, average density, communities and coverage."""
    q = quality(graph, membership).agg(
        F.count("*").alias("communities"), F.avg("conductance").alias("conductance"), (F.sum(F.col("conductance") * F.col("size")) / F.sum("size")).alias("weighted_conductance"), F.avg("density").alias("density")
    )
    return q.join(F.broadcast(modularity(graph, membership))).join(F.broadcast(coverage(graph, membership)))  # one row each


def _turn(vertex: Column, r: int) -> Column:
    """Whether a vertex belongs to the half that moves in round r."""
    return F.pmod(F.xxhash64(vertex, F.lit(r)), F.lit(2)) == 0


def _local_moves(step: DataFrame, degree: DataFrame, n: int, member: DataFrame, m: float, rounds: int, within: DataFrame | None = None, threshold: float = 1e-4, side: Callable[[DataFrame, int], DataFrame] = sized) -> tuple[DataFrame, bool]:
    """member (id, community) after rounds of local moving, and whether any vertex moved.

    In each round the vertices of one half, by hash and round, move to the community
    around them with the largest gain; ties go to the smallest. With within (id, part),
    moves stay inside a part, only vertices that are alone move, and they join
    communities whose naming vertex does not move in this round. Two rounds are a
    sweep. Vertices that move at once may undo each other, so it is the whole that has
    to gain: sweeps go on until one adds less than the threshold to the modularity,
    and the best division met stays. A round is one job, which also sums up the
    modularity of the division that it starts from.
    """
    around = step.where("u <> v")
    state = checkpointed(member.join(degree, "id").select("id", "community", "k"))
    if within is not None:
        a, b = within.select(F.col("id").alias("u"), F.col("part").alias("pu")), within.select(F.col("id").alias("v"), F.col("part").alias("pv"))
        around = checkpointed(around.join(side(a, n), "u").join(side(b, n), "v").where("pu = pv").select("u", "v", "w"))
    best, best_q, any_moved, moved_before = state, None, False, 1
    for r in range(2 * rounds + 1):
        total = state.groupBy("community").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
        links = around.join(side(state.select(F.col("id").alias("v"), "community"), n), "v").groupBy("u", "community").agg(F.sum("w").alias("inside"))
        own = state.join(side(total, n), "community").select(F.col("id").alias("u"), F.col("community").alias("own"), "k", F.col("tot").alias("own_tot"), F.col("size").alias("own_size"))
        tried = links.join(side(own, n), "u").join(side(total.select("community", "tot"), n), "community")
        mine = F.col("community") == F.col("own")
        # Gain up to a constant of the vertex: links less expected links, its own community without itself.
        value = F.round(F.col("inside") - F.col("k") * (F.col("tot") - F.when(mine, F.col("k")).otherwise(0.0)) / (2 * m), 9)
        open_to = _turn(F.col("u"), r)
        if within is not None:
            open_to &= (F.col("own_size") == 1) & (mine | ~_turn(F.col("community"), r))
        choice = F.min(F.when(open_to, F.struct((-value).alias("worse"), "community")))
        top = tried.groupBy("u").agg(choice.alias("b"), F.max(F.when(mine, value)).alias("stay"), F.max(F.when(mine, F.col("inside"))).alias("inside"))
        better = (-F.col("b.worse") > F.coalesce("stay", F.lit(0.0))) & (F.col("b.community") != F.col("own"))
        moved = F.coalesce(better, F.lit(False))
        nxt = own.join(side(top, n), "u", "left").select(F.col("u").alias("id"), F.when(moved, F.col("b.community")).otherwise(F.col("own")).alias("community"), "k", F.coalesce("inside", F.lit(0.0)).alias("inside"), "own_tot", moved.alias("moved"))
        last, (state, (inside, squares, changed)) = state, measured(nxt, F.sum("inside"), F.sum(F.col("k") * F.col("own_tot")), F.sum(F.col("moved").cast("int")))
        if r % 2 == 0:  # what entered this round is the outcome of a sweep
            q = (inside or 0.0) / (2 * m) - (squares or 0.0) / (4 * m * m) if m else 0.0
            if best_q is not None and q < best_q + threshold:
                return (last if q > best_q else best).select("id", "community"), any_moved
            best, best_q = last, q
        elif not changed and not moved_before:
            return state.select("id", "community"), any_moved
        any_moved, moved_before = any_moved or bool(changed), changed
    return best.select("id", "community"), any_moved


def _levels(graph: Graph, rounds: int, levels: int, refine: bool, weight: str | None) -> DataFrame:
    side = looped if refine else sized  # leiden joins about twice as often, and what it broadcasts adds up
    edges, (m,) = measured(weighed(graph, weight), F.coalesce(F.sum("w"), F.lit(0.0)))
    ids = checkpointed(graph.ids())
    whole = ids.select("id", F.col("id").alias("node"))
    step = checkpointed(Graph(edges).adjacency("w").groupBy("u", "v").agg(F.sum("w").alias("w")))
    found, member = ids.select("id", F.col("id").alias("community")), None
    for _ in range(levels):
        degree, (n,) = measured(step.groupBy(F.col("u").alias("id")).agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k")), F.count("*"))
        alone = degree.select("id", F.col("id").alias("community"))
        member, moved = _local_moves(step, degree, n, alone if member is None else member, m, rounds, side=side)
        top = member.select(F.col("id").alias("node"), "community")
        found = checkpointed(whole.join(side(top, n), "node", "left").select("id", F.coalesce("community", "node").alias("community")))
        if not moved:
            break
        parts = member
        if refine:
            parts, _ = _local_moves(step, degree, n, alone, m, rounds, member.withColumnRenamed("community", "part"), side=side)
        part = parts.select(F.col("id").alias("node"), F.col("community").alias("next"))
        whole = checkpointed(whole.join(side(part, n), "node", "left").select("id", F.coalesce("next", "node").alias("node")))
        a, b = parts.select(F.col("id").alias("u"), F.col("community").alias("a")), parts.select(F.col("id").alias("v"), F.col("community").alias("b"))
        inner = F.when((F.col("a") == F.col("b")) & (F.col("u") != F.col("v")), F.col("w") / 2).otherwise(F.col("w"))
        step = checkpointed(step.join(side(a, n), "u").join(side(b, n), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), inner.alias("w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
        # The next level starts from the communities, each named by one of its parts.
        joined = parts.join(side(member.withColumnRenamed("community", "top"), n), "id").select(F.col("community").alias("id"), "top").distinct()
        name = joined.groupBy("top").agg(F.min("id").alias("community"))
        member = checkpointed(joined.join(name, "top").select("id", "community")) if refine else None
    return found


def louvain(graph: Graph, rounds: int = 20, levels: int = 3, weight: str | None = None) -> DataFrame:
    """id and community: sweeps of local moving until none moves, then communities become vertices, level by level."""
    return _levels(graph, rounds, levels, False, weight)


def leiden(graph: Graph, rounds: int = 20, levels: int = 3, weight: str | None = None) -> DataFrame:
    """id and community: as louvain, but the vertices of a level are refined parts of the communities, which keep their place.

    Parts grow inside a community from single vertices only; at the end communities
    that are not connected fall into their components.
    """
    return split_disconnected(graph, _levels(graph, rounds, levels, True, weight))


def split_disconnected(graph: Graph, membership: DataFrame) -> DataFrame:
    """Communities that are not connected fall into their components."""
    inside = _with_ends(graph.edges.select("src", "dst"), membership).where("ca = cb").select("src", "dst")
    parts = components(Graph(inside, membership.select("id")))
    return parts.select("id", F.col("component").alias("community"))
