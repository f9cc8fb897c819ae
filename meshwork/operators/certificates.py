"""What proves or refutes a property of a graph: cycles, sparse certificates, colour classes, forced orientations, triples, elimination.

Each answer is a table of witnesses that joins found, not a yes or no alone.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.statistics import in_ranges, running
from meshwork.graph import Graph, checkpointed, dropped, looped, measured, sized
from meshwork.operators import hierarchy, motifs
from meshwork.operators.traversal import min_labels, topological_levels


def cycles(graph: Graph) -> DataFrame:
    """cycle (its smallest vertex), position (0 to length - 1, along the edges) and id of disjoint cycles of a directed graph.

    What topological peeling leaves has an edge from within to each vertex. The
    smallest such source of each vertex is its pointer; following pointers for as many
    steps as there are vertices, by doubling them, ends on cycles. A graph without
    cycles gives no rows; a loop is a cycle of one vertex.
    """
    left = checkpointed(topological_levels(graph).where("level IS NULL").select("id"))
    inside = graph.edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
    pointer, (n,) = measured(inside.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("back")), F.count("*"))
    far, steps = pointer, 1
    while steps < n:
        far = checkpointed(far.join(sized(far.select(F.col("id").alias("back"), F.col("back").alias("next")), n, 32), "back").select("id", F.col("next").alias("back")))
        steps *= 2
    on = far.select(F.col("back").alias("id")).distinct()
    # Along a cycle: the smallest vertex met within 2^k steps back, and then the steps back to it.
    ring, (n,) = measured(pointer.join(on, "id", "left_semi").select("id", "back", F.least("id", "back").alias("low")), F.count("*"))
    steps = 1
    while steps < n:
        other = sized(ring.select(F.col("id").alias("back"), F.col("back").alias("next"), F.col("low").alias("far_low")), n, 48)
        ring = checkpointed(ring.join(other, "back").select("id", F.col("next").alias("back"), F.least("low", "far_low").alias("low")))
        steps *= 2
    rank = checkpointed(ring.select("id", F.col("low").alias("cycle")).join(pointer, "id").select("id", "cycle", F.when(F.col("id") == F.col("cycle"), F.col("id")).otherwise(F.col("back")).alias("back"), F.when(F.col("id") == F.col("cycle"), 0).otherwise(1).alias("position")))
    steps = 1
    while steps < n:
        other = sized(rank.select(F.col("id").alias("back"), F.col("back").alias("next"), F.col("position").alias("more")), n, 48)
        rank = checkpointed(rank.join(other, "back").select("id", "cycle", F.col("next").alias("back"), (F.col("position") + F.col("more")).alias("position")))
        steps *= 2
    return rank.select("cycle", "position", "id")


def sparse_certificate(graph: Graph, k: int) -> DataFrame:
    """src < dst and forest (1 to k) of k edge-disjoint spanning forests, each of what the ones before leave.

    They hold k (n - 1) edges at most, and every cut of the graph of up to k edges whole.
    """
    left = checkpointed(graph.undirected().edges.select("src", "dst"))
    out: DataFrame | None = None
    for f in range(1, k + 1):
        forest = hierarchy.spanning_forest(Graph(left, graph.ids()))
        rows = forest.select("src", "dst", F.lit(f).alias("forest"))
        out = rows if out is None else out.unionByName(rows)
        left, (n,) = measured(left.join(forest, ["src", "dst"], "left_anti"), F.count("*"))
        if not n:
            break
    return out


def edge_connectivity_bounds(graph: Graph, k: int) -> DataFrame:
    """One row: at_least (leading forests that span the graph: so many disjoint trees) and at_most (the smallest degree, and k where all span)."""
    plain = graph.undirected()
    n = graph.ids().count()
    sizes = {r["forest"]: r["count"] for r in sparse_certificate(plain, k).groupBy("forest").count().collect()}  # k rows
    at_least = 0
    while sizes.get(at_least + 1) == n - 1 and n > 1:
        at_least += 1
    degrees = plain.neighbours().groupBy("u").count()
    low = graph.ids().join(degrees.withColumnRenamed("u", "id"), "id", "left").agg(F.min(F.coalesce("count", F.lit(0))).alias("at_most"))
    return low.select(F.lit(at_least).alias("at_least"), "at_most")


def colour_classes(graph: Graph, rounds: int | None = None) -> DataFrame:
    """id and colour (the smallest vertex of its class) of the coarsest stable partition: equal colours see equal numbers of each colour.

    Refinement by the multiset of neighbours' colours, of which a sum of hashes over
    (colour, count) is kept, so that a hub gathers nothing. Vertices that a symmetry
    maps on each other share a colour; the number of colours bounds the orbits from below.
    """
    around = checkpointed(graph.neighbours())
    colour, (classes,) = measured(graph.ids().select("id", F.lit(None).cast(graph.ids().schema["id"].dataType).alias("colour")), F.lit(0) + F.count("colour"))
    done = 0
    while rounds is None or done < rounds:
        seen = around.join(colour.select(F.col("id").alias("v"), F.col("colour")), "v").groupBy("u", "colour").agg(F.count("*").alias("c"))
        mark = F.struct(*(F.sum(F.xxhash64("colour", "c", F.lit(salt)).cast("decimal(38,0)")).alias(f"m{salt}") for salt in (1, 2)))
        marks = seen.groupBy(F.col("u").alias("id")).agg(mark.alias("mark"))
        both = colour.join(marks, "id", "left")
        name = both.groupBy("colour", "mark").agg(F.min("id").alias("new"))
        same = both["colour"].eqNullSafe(name["colour"]) & both["mark"].eqNullSafe(name["mark"])
        last, (colour, (now,)) = colour, measured(both.join(name, same).select("id", F.col("new").alias("colour")), F.sum((F.col("id") == F.col("colour")).cast("long")))
        dropped(last)
        done += 1
        if now == classes:
            return colour
        classes = now
    return colour


def forced_arcs(graph: Graph) -> DataFrame:
    """src, dst and class of every arc of both directions: arcs of a class point the same way in each transitive orientation.

    Two arcs force each other when they share their source, or their target, and their
    other ends are no neighbours. class is the smallest arc (src, dst) of it.
    """
    around = checkpointed(graph.neighbours())
    # What is no neighbour of a pivot is tied to it, so only the pivot and its neighbours are paired with all around u:
    # two others that are apart are both tied to the pivot. The pivot has the fewest neighbours around u.
    corners = F.explode(F.array(*(F.struct(*(F.col(c).alias(x) for c, x in zip(order, "uvw", strict=True))) for order in itertools.permutations("abc")))).alias("t")
    inside = checkpointed(motifs.triangles(graph).select(corners).select("t.*"))
    few = around.join(inside.groupBy("u", "v").agg(F.count("*").alias("k")), ["u", "v"], "left")
    pivot = checkpointed(few.groupBy("u").agg(F.min_by("v", F.struct(F.coalesce("k", F.lit(0)), "v")).alias("p")))
    chosen = pivot.select("u", F.col("p").alias("v")).union(inside.join(pivot, "u").where("v = p").select("u", "w"))
    pairs = chosen.join(around.select("u", F.col("v").alias("w")), "u").where("v <> w")
    apart = checkpointed(pairs.join(around.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_anti"))
    arc = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    forces = apart.select(arc("u", "v").alias("a"), arc("u", "w").alias("b")).union(apart.select(arc("v", "u").alias("a"), arc("w", "u").alias("b")))
    labels = min_labels(forces)
    every = around.select(arc("u", "v").alias("node"))
    return every.join(labels, "node", "left").select("node.src", "node.dst", F.coalesce("label", "node").alias("class"))


def orientation_conflicts(arcs: DataFrame) -> DataFrame:
    """src < dst of the edges whose two directions are forced by each other: a graph is a comparability graph exactly without them."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("class").alias("back"))
    return arcs.join(back, ["src", "dst"]).where((F.col("class") == F.col("back")) & (F.col("src") < F.col("dst"))).select("src", "dst")


def apart_components(graph: Graph) -> DataFrame:
    """x, id and component (its smallest vertex) of the graph without the closed neighbourhood of x, for all x at once.

    A row for each pair of vertices that are neither equal nor neighbours.
    """
    around = checkpointed(graph.neighbours())
    ids = checkpointed(graph.ids())
    far = ids.select(F.col("id").alias("x")).join(ids, F.col("x") != F.col("id")).join(around.select(F.col("u").alias("x"), F.col("v").alias("id")), ["x", "id"], "left_anti")
    far = checkpointed(far)
    node = lambda v: F.struct(F.col("x"), F.col(v).alias("id"))
    inside = far.join(around.where("u < v"), far["id"] == around["u"]).select("x", "u", "v").join(far.select("x", F.col("id").alias("v")), ["x", "v"], "left_semi")
    labels = min_labels(inside.select(node("u").alias("a"), node("v").alias("b")))
    return far.join(labels.select("node.x", "node.id", F.col("label.id").alias("low")), ["x", "id"], "left").select("x", "id", F.coalesce("low", "id").alias("component"))


def _numbered(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """id, i (0, 1, ...: by component, then by id), c (the component's first i) and root of every vertex, and the edges both ways as i and j.

    root is the vertex of most neighbours in the component that is neither the vertex
    nor a neighbour of it; null where there is none.
    """
    around = checkpointed(graph.neighbours())
    parts = min_labels(around.select(F.col("u").alias("a"), F.col("v").alias("b"))).select("node", "label")
    degree = around.groupBy(F.col("u").alias("id")).agg((-F.count("*")).alias("few"))
    facts, (n,) = measured(degree.join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("label"), "few"), F.count("*"))
    for name, order in (("i", ["label", "id"]), ("k", ["label", "few", "id"])):
        by = [F.col(c) for c in order]
        facts = running(in_ranges(facts.drop("_p"), *by), by, F.lit(1), name).withColumn(name, F.col(name) - 1)
    facts = checkpointed(facts.select("id", "label", "i", "k"))
    facts = checkpointed(facts.join(sized(facts.groupBy("label").agg(F.min("i").alias("c"), F.count("*").alias("size")), n, 32), "label").select("id", "i", "k", "c", "size"))
    a, b = facts.select(F.col("id").alias("u"), "i"), facts.select(F.col("id").alias("v"), F.col("i").alias("j"), F.col("k").alias("kj"))
    edges = checkpointed(around.join(sized(a, n, 24), "u").join(sized(b, n, 32), "v").select("i", "j", "kj"))
    # The first k of the component that no vertex next to i has: one more than a k that one has (or than none), while that is not taken too.
    taken = edges.select("i", F.col("kj").alias("k")).union(facts.select("i", "k"))
    tried = taken.select("i", (F.col("k") + 1).alias("k")).union(facts.select("i", F.col("c").alias("k")))
    open_k = tried.join(taken, ["i", "k"], "left_anti").groupBy("i").agg(F.min("k").alias("k"))
    root = facts.select(F.col("i").alias("root"), "k", F.col("c").alias("rc"))
    found = open_k.join(sized(root, n, 32), "k").select("i", "root", "rc")
    return checkpointed(facts.join(found, "i", "left").select("id", "i", "c", "size", F.when(F.col("rc") == F.col("c"), F.col("root")).alias("root"))), edges.select("i", "j")


#: Rounds in which the vertices around a root are reached by bits; what is farther goes by labels.
BIT_ROUNDS = 12


def _bit(i: str) -> Column:
    """The word with the bit of vertex number i."""
    return F.expr(f"shiftleft(1L, cast({i} % 64 as int))")


def _reached(facts: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """What the root of x reaches away from x and its neighbours, as (block, j, word) with a bit for each x of a block of 64, and the other (x, j, component).

    An other vertex that is in the root's component after all has a null component.
    """
    # Tables of bits and of pairs are small in files and large in memory: none of them may be broadcast by the size of its files.
    near = looped(edges, edges.count())
    block = lambda c: F.expr(f"{c} div 64")
    beside = edges.union(facts.select("i", F.col("i").alias("j")))
    closed = checkpointed(beside.groupBy(block("i").alias("block"), "j").agg(F.bit_or(_bit("i")).alias("closed")))
    fresh = checkpointed(facts.where("root IS NOT NULL").groupBy(block("i").alias("block"), F.col("root").alias("j")).agg(F.bit_or(_bit("i")).alias("word")))
    seen, r = fresh, 0
    while r < BIT_ROUNDS:
        r += 1
        met = fresh.join(near.withColumnRenamed("j", "to"), F.col("j") == F.col("i")).groupBy("block", F.col("to").alias("j")).agg(F.bit_or("word").alias("word"))
        old = seen.withColumnRenamed("word", "old")
        both = met.join(closed.hint("shuffle_hash"), ["block", "j"], "left").join(old, ["block", "j"], "full")
        none = F.lit(0).cast("long")
        new = F.coalesce("word", none).bitwiseAND(F.bitwise_not(F.coalesce("closed", none))).bitwiseAND(F.bitwise_not(F.coalesce("old", none)))
        last, (both, (more,)) = seen, measured(both.select("block", "j", F.coalesce("old", none).bitwiseOR(new).alias("word"), new.alias("new")), F.sum((F.col("new") != 0).cast("int")))
        seen, fresh = both.select("block", "j", "word"), both.where("new <> 0").select("block", "j", F.col("new").alias("word"))
        if not more:
            break
    seen = checkpointed(seen.where("word <> 0"))
    # Left: members of x's component that are neither reached nor next to x. Vertices of which all of a block are done have no row.
    blocks = facts.select(block("i").alias("block"), "c", "size", _bit("i").alias("b")).groupBy("block", "c", "size").agg(F.bit_or("b").alias("mine"))
    every = blocks.select("block", "mine", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("size") - 1)).alias("j"))
    done = seen.join(closed, ["block", "j"], "full").select("block", "j", F.coalesce("word", F.lit(0).cast("long")).bitwiseOR(F.coalesce("closed", F.lit(0).cast("long"))).alias("done"))
    left = every.join(done.hint("merge"), ["block", "j"], "left").select("block", "j", F.col("mine").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long")))).alias("word")).where("word <> 0")
    rest = checkpointed(_members(left).select(F.col("i").alias("x"), "j"))
    node = lambda c: F.struct(F.col("x"), F.col(c).alias("j"))
    ties = rest.join(near.select(F.col("i").alias("from"), F.col("j").alias("to")), F.col("j") == F.col("from")).select("x", "from", "to")
    inside = ties.join(rest.withColumnRenamed("j", "to").hint("merge"), ["x", "to"], "left_semi").select(node("from").alias("a"), node("to").alias("b"))
    out = ties.join(_members(seen).select(F.col("i").alias("x"), F.col("j").alias("to")).hint("merge"), ["x", "to"], "left_semi").select(node("from").alias("a"), F.struct("x", F.lit(-1).cast("long").alias("j")).alias("b")) if more else inside.limit(0)
    labels = min_labels(inside.union(out)).select("node.x", "node.j", F.col("label.j").alias("low"))
    rest = checkpointed(rest.join(labels, ["x", "j"], "left").select("x", "j", F.when(F.col("low").isNull(), F.col("j")).when(F.col("low") >= 0, F.col("low")).alias("component")))
    return seen, rest


def _members(words: DataFrame) -> DataFrame:
    """words (block, j, word) as a row (i, j) for each bit."""
    each = words.select("block", "j", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return each.where("shiftright(word, bit) & 1 = 1").select((F.col("block") * 64 + F.col("bit")).alias("i"), "j")


#: Words of 64 vertices in a strip.
STRIP = 16


def asteroidal_triples(graph: Graph) -> DataFrame:
    """a < b < c, each two of which a way joins that stays away from the third and its neighbours; interval graphs have none.

    Nearly all vertices far from x are in one component of what x leaves, that of a
    root. Where this holds of all three, a triple is a triangle of the graph of pairs
    that are in each other's root's component: words of a and of b that say so of 64
    vertices are cut. Triples of which one sees the others in another component are
    found from the pairs in such components.
    """
    facts, edges = _numbered(graph)
    n = facts.count()
    seen, rest = _reached(facts, edges, n)
    to = checkpointed(_members(seen).select(F.col("i").alias("x"), "j").union(rest.where("component IS NULL").select("x", "j")))
    mutual = checkpointed(to.join(to.select(F.col("x").alias("j"), F.col("j").alias("x")).hint("merge"), ["x", "j"]).select("x", "j"))
    ids = facts.select("i", "id")
    named = ids.groupBy(F.expr(f"i div {64 * STRIP}").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda r: r["id"]).alias("ids"))
    words = mutual.groupBy("x", F.expr(f"j div {64 * STRIP}").alias("s")).agg(*(F.coalesce(F.bit_or(F.expr(f"CASE WHEN j div 64 % {STRIP} = {k} THEN shiftleft(1L, cast(j % 64 as int)) END")), F.lit(0).cast("long")).alias(f"w{k}") for k in range(STRIP)))
    words = checkpointed(words)
    w = lambda c: F.array(*(f"w{k}" for k in range(STRIP))).alias(c)
    pairs = mutual.where("x < j").join(words.select("x", "s", w("wa")).hint("merge"), "x").where(f"s >= j div {64 * STRIP}")
    strips = pairs.join(words.select(F.col("x").alias("j"), "s", w("wb")).hint("merge"), ["j", "s"])
    name = lambda c, out: sized(ids.select(F.col("i").alias(c), F.col("id").alias(out)), n, 24)
    strips = strips.join(name("x", "a"), "x").join(name("j", "b"), "j").join(sized(named, n, 16), "s").select("a", "b", "s", "j", "ids", "wa", "wb")
    cut = strips.select("a", "b", "s", "j", "ids", F.posexplode(F.zip_with("wa", "wb", lambda p, q: p.bitwiseAND(q))).alias("at", "word")).where("word <> 0")
    bits = cut.select("a", "b", "s", "j", "ids", "at", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where(f"shiftright(word, bit) & 1 = 1 AND (s * {STRIP} + at) * 64 + bit > j")
    alike = bits.select("a", "b", F.expr("ids[at * 64 + bit]").alias("c"))
    # Pairs that x sees in one component, but not its root's.
    apart = checkpointed(rest.where("component IS NOT NULL"))
    if apart.isEmpty():
        return alike
    both = apart.join(apart.select("x", F.col("j").alias("k"), "component"), ["x", "component"]).where("j < k").select("x", "j", "k")
    sees = checkpointed(apart.union(to.select("x", "j", F.lit(None).cast("long").alias("component"))))
    for y, z in (("j", "k"), ("k", "j")):
        there = lambda v, name, y=y: sees.select(F.col("x").alias(y), F.col("j").alias(v), F.coalesce("component", F.lit(-1)).alias(name))
        both = both.join(there("x", "p"), [y, "x"]).join(there(z, "q"), [y, z]).where("p = q").select("x", "j", "k")
    triple = both.select(F.array_sort(F.array("x", "j", "k")).alias("t")).distinct().select(F.col("t")[0].alias("i0"), F.col("t")[1].alias("i1"), F.col("t")[2].alias("i2"))
    return alike.unionByName(triple.join(name("i0", "a"), "i0").join(name("i1", "b"), "i1").join(name("i2", "c"), "i2").select("a", "b", "c"))


#: Vertices in a word of a row of bits; the sign is left out, so that a word less one never overflows.
WORD = 62


def _place(i: str) -> Column:
    """The word with the bit of vertex number i among those of its block of WORD."""
    return F.expr(f"shiftleft(1L, cast({i} % {WORD} as int))")


def _ends(words: DataFrame) -> DataFrame:
    """words (u, s, word) as a row (u, v) for each bit."""
    each = words.select("u", "s", "word", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("bit"))
    return each.where("shiftright(word, bit) & 1 = 1").select("u", (F.col("s") * WORD + F.col("bit")).alias("v"))


#: A look for components that are cliques is made in every so many rounds.
CLIQUE_ROUNDS = 4


def _told(goes: DataFrame, words: DataFrame, degree: DataFrame, r: int, block) -> DataFrame:
    """goes, and all members of components that are cliques with the rounds in which they go.

    As many vertices as one of them has neighbours, all of equal degree, are a clique
    where all of them and their neighbours are no more.
    """
    alike, (k,) = measured(degree.groupBy("m").agg(F.count("*").alias("size"), F.min("d").alias("low"), F.max("d").alias("high")).where("size > 1 AND low = high AND high = size - 1").select("m", "size"), F.count("*"))
    if not k:
        return goes
    member = degree.join(sized(alike, k, 24), "m").select("i", "m", "size")
    closed = words.join(member.withColumnRenamed("i", "u"), "u").select("m", "size", "s", "word").union(member.select("m", "size", block("i"), _place("i")))
    cliques = closed.groupBy("m", "size", "s").agg(F.bit_or("word").alias("word")).groupBy("m", "size").agg(F.sum(F.bit_count("word")).alias("c")).where("c = size").select("m")
    told = checkpointed(degree.join(cliques, "m", "left_semi").select("i", (F.lit(r) + F.col("below")).cast("int").alias("round"), (F.col("d") - F.col("below")).alias("degree"), F.lit(True).alias("told")))
    return goes.join(told.select("i"), "i", "left_anti").unionByName(told)


def elimination(graph: Graph) -> DataFrame:
    """id, round and degree when eliminated: in each round all vertices go whose (degree, id) is the smallest around, their neighbours becoming neighbours.

    The largest degree bounds the treewidth from above. Of a component that is a clique
    one vertex goes a round, by id, and a clique is left: its members' rounds and
    degrees are told at once, from their places among their neighbours. What is left
    fills up, so neighbours are kept as bits, a row for each block of WORD numbers.
    """
    by = [F.col("id")]
    numbered = running(in_ranges(graph.ids(), *by), by, F.lit(1), "n").select("id", (F.col("n") - 1).alias("i"))
    number, (n,) = measured(numbered, F.count("*"))
    block = lambda c: F.expr(f"{c} div {WORD}")
    none = F.lit(0).cast("long")
    pairs = graph.neighbours().join(number.select(F.col("id").alias("u"), "i"), "u").join(number.select(F.col("id").alias("v"), F.col("i").alias("j")), "v")
    every = pairs.select(F.col("i").alias("u"), block("j").alias("s"), _place("j").alias("word")).union(number.select("i", block("i"), none))
    # A vertex that is left has a row for its own block, whether it has neighbours there or not.
    words = checkpointed(every.groupBy("u", "s").agg(F.bit_or("word").alias("word")))
    out: DataFrame | None = None
    r = 0
    key = lambda c, d: F.struct(F.col(d).alias("d"), F.col(c).alias("i"))
    while True:
        under = F.when(F.col("s") < block("u"), F.col("word")).when(F.col("s") == block("u"), F.col("word").bitwiseAND(_place("u") - 1)).otherwise(none)
        first = F.col("s") * WORD + F.bit_count((F.col("word") - 1).bitwiseAND(F.bitwise_not("word")))
        facts = words.groupBy(F.col("u").alias("i")).agg(F.sum(F.bit_count("word").cast("long")).alias("d"), F.min(F.least("u", first)).alias("m"), F.sum(F.bit_count(under).cast("long")).alias("below"))
        degree, (n,) = measured(facts, F.count("*"))
        if not n:
            break
        r += 1
        # Most vertices have the smallest of some block as neighbour; only the others' neighbours are looked at one by one.
        ranked = lambda c, d: sized(degree.select(F.col("i").alias(c), F.col("d").alias(d)), n, 32)  # noqa: E731, B023
        lows = degree.groupBy(block("i").alias("s")).agg(F.min(key("i", "d")).alias("low"))
        beaten = (F.col("low") < key("u", "d")) & (F.col("word").bitwiseAND(_place("low.i")) != 0)
        rated = words.join(ranked("u", "d"), "u").join(sized(lows, -(-n // WORD), 32), "s", "left").groupBy("u", "d").agg(F.max(F.coalesce(beaten, F.lit(False))).alias("beaten"), F.collect_list(F.struct("s", "word")).alias("words"))
        ends = F.explode(F.flatten(F.transform("words", lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.when(w["word"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0, w["s"] * WORD + b)), lambda v: v.isNotNull()))))
        may = rated.where("NOT beaten")
        near = may.where("d > 0").select("u", "d", ends.alias("v")).join(ranked("v", "dv"), "v").groupBy("u", "d").agg(F.min(key("v", "dv")).alias("low")).where(key("u", "d") < F.col("low"))
        goes = near.select("u", "d").union(degree.where("d = 0").select("i", "d")).select(F.col("u").alias("i"), F.lit(r).alias("round"), F.col("d").alias("degree"), F.lit(False).alias("told"))
        if r % CLIQUE_ROUNDS == 1:
            goes = _told(goes, words, degree, r, block)
        goes, (g,) = measured(goes, F.count("*"))
        out = goes if out is None else out.unionByName(goes)
        gone = sized(goes.select(F.col("i").alias("u")), g, 16)
        theirs = words.join(sized(goes.where("NOT told").select(F.col("i").alias("u")), g, 16), "u", "left_semi")
        fill = _ends(theirs).join(theirs, "u").select(F.col("v").alias("u"), "s", "word")
        away = goes.groupBy(block("i").alias("s")).agg(F.bit_or(_place("i")).alias("away"))
        rows = words.join(gone, "u", "left_anti").unionByName(fill).groupBy("u", "s").agg(F.bit_or("word").alias("word")).join(sized(away, g, 24), "s", "left")
        own = F.col("s") == block("u")
        others = F.bitwise_not(F.coalesce("away", none)).bitwiseAND(F.bitwise_not(F.when(own, _place("u")).otherwise(none)))
        last, words = words, checkpointed(rows.select("u", "s", F.col("word").bitwiseAND(others).alias("word"), own.alias("own")).where("word <> 0 OR own").drop("own"))
        dropped(last, degree)
    if out is None:
        return number.select("id", F.lit(0).alias("round"), F.lit(0).cast("long").alias("degree"))
    return out.join(number, "i").select("id", "round", "degree")
