"""Seeded expansion: each query (a set of seeds) grows from its seeds, its most urgent vertices first, until it may stop.

Strict one-by-one order would be a job per vertex. Urgency is cut into bands instead,
and a round expands every frontier vertex of a query's lowest band, for all queries at
once. A round is one job: it reads the open rows of the round before and writes those
of the next, new vertices among them. New rows carry the number of their round and
are never written again as new, so what is owned is the union of all rounds' new rows.
What a query reaches when nothing is left to expand does not depend on the order;
parents, depths, rounds and where seeds meet first do.

Feedback orders change a vertex's urgency with the paths that were found: where two
seeds of a query come to own one vertex, their ways to it make a path, and the vertices
on and around new paths raise a keyed table of feedback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, Observation, checkpointed, looped, measured, scratch, sized
from meshwork.operators import tiles
from meshwork.operators.paths import signature
from meshwork.operators.traversal import min_labels, walked_back

#: Orders whose bands need the state of the expansion, and those of them that follow the paths found.
FEEDBACK = ("retrospective", "adaptive")
MOVING = ("breadth_first", "frontier_balanced", "cross_seed", "path_preserving", *FEEDBACK)
#: The adaptive order's stop: so many paths, so large a share of different vertices on them, and a mean salience that the last
#: WINDOW paths' raise by no more than PLATEAU over the WINDOW before.
MIN_PATHS, DIVERSITY, WINDOW, PLATEAU = 3, 0.5, 5, 0.01


def _doubling(x: Column) -> Column:
    """The whole part of log2(x + 1), exact: the binary digits of the whole part of x + 1, less one."""
    return (F.length(F.bin(F.floor(F.greatest(x, F.lit(0.0))).cast("long") + 1)) - 1).cast("int")


def band(order: str) -> Column:
    """Band of a frontier vertex, lower first.

    Over degree, spread (of its neighbours' degrees from its own, in deviations),
    entropy, score, depth, size (of its seed's frontier), owners, potential and feedback.
    """
    d = F.col("degree").cast("double")
    return {
        "breadth_first": F.col("depth"),
        "degree": _doubling(d),
        "high_degree": -_doubling(d),
        "frontier_balanced": F.col("size").cast("int"),
        "random": F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 7), 16, 10).cast("int") % 8,
        "degree_surprise": -_doubling(F.round(F.col("spread"), 9)),
        "entropy_guided": _doubling(F.round(10 * F.log(d + 1) / (F.col("entropy") + 0.001), 9)),
        "salience": -_doubling(F.round(1000 * F.col("score"), 9)),
        "cross_seed": _doubling((d + 1) * (1 + F.col("owners"))),
        "path_preserving": _doubling(d / (1 + F.col("potential"))),
        "retrospective": _doubling(F.round(4 * d * (1 - F.col("feedback")), 9)),
        "adaptive": _doubling(F.round(4 * d / (1 + F.col("potential")) / (1 + F.col("feedback")), 9)),
    }[order]


ORDERS = ("breadth_first", "degree", "high_degree", "frontier_balanced", "random", "degree_surprise", "entropy_guided", "salience", "cross_seed", "path_preserving", *FEEDBACK)


def vertex_facts(graph: Graph, scores: DataFrame | None = None) -> DataFrame:
    """id, degree, spread, the entropy (bits) of the types of the vertex's edges, and its score."""
    step = graph.adjacency("type") if "type" in graph.edges.columns else graph.adjacency().withColumn("type", F.lit(0))
    kinds = checkpointed(step.groupBy("u", "type").agg(F.count("*").alias("c")))
    total = checkpointed(kinds.groupBy("u").agg(F.sum("c").alias("degree")))
    p = F.col("c") / F.col("degree")
    entropy = kinds.join(total, "u").groupBy("u", "degree").agg((-F.sum(p * F.log2(p))).alias("entropy"))
    around = step.join(total.select(F.col("u").alias("v"), F.col("degree").alias("d")), "v").groupBy("u").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"))
    gap = F.abs(F.col("degree") - F.col("mean"))
    facts = entropy.join(around, "u").select(F.col("u").alias("id"), "degree", F.when(F.col("sd") > 0, gap / F.col("sd")).otherwise(gap).alias("spread"), "entropy")
    if scores is None:
        return facts.withColumn("score", F.lit(0.0))
    return facts.join(scores.select("id", F.col("score").cast("double").alias("score")), "id", "left").na.fill(0.0, ["score"])


class _Rounds:
    """The tables of the rounds in one folder: the open rows of the last one, and all new rows."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark, self.folder, self.last, self.owned_rows = rows.sparkSession, scratch(rows.sparkSession, "rounds"), -1, 0
        self.schema, self.kept, self.kept_of = rows.withColumn("at", F.lit(0)).schema, None, None
        self.write(rows)

    def write(self, rows: DataFrame) -> int:
        """The number of open rows after another round."""
        self.last += 1
        seen = Observation()
        rows = rows.withColumn("at", F.lit(self.last)).select(self.schema.names)
        rows.observe(seen, F.count("*").alias("open"), F.coalesce(F.sum((F.col("round") == self.last).cast("int")), F.lit(0)).alias("fresh")).write.parquet(f"{self.folder}/r{self.last}")
        self.owned_rows += seen.get["fresh"]
        return seen.get["open"]

    def narrow(self, rows: DataFrame) -> int:
        """Leave these of the last round's open rows only; what it made its own stays owned."""
        self.kept = checkpointed(rows)
        self.kept_of = self.last
        return self.kept.count()

    def open(self) -> DataFrame:
        if self.kept_of == self.last:
            return self.kept
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/r{self.last}").drop("at")

    def owned(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.folder).where("round = at").drop("at")


def _ranked(rounds: _Rounds, step: DataFrame, order: str, feedback: DataFrame | None) -> DataFrame:
    """Open rows with their band."""
    waiting, owned, n = rounds.open(), rounds.owned(), rounds.owned_rows
    if order not in MOVING:
        return waiting
    if order == "frontier_balanced":
        waiting = waiting.join(waiting.groupBy("query", "seed").agg(F.count("*").alias("size")), ["query", "seed"])
    elif order == "cross_seed":
        waiting = waiting.join(looped(owned.groupBy("query", "id").agg(F.countDistinct("seed").alias("owners")), n), ["query", "id"])
    elif order in ("path_preserving", "adaptive"):
        near = waiting.select("query", "seed", "id").join(step, F.col("id") == F.col("u")).join(looped(owned.select("query", F.col("seed").alias("other"), F.col("id").alias("v")), n), ["query", "v"])
        potential = near.where("other <> seed").groupBy("query", "seed", "id").agg(F.countDistinct("v").alias("potential"))
        waiting = waiting.join(looped(potential, n), ["query", "seed", "id"], "left").na.fill(0, ["potential"])
    if order in FEEDBACK:
        known = waiting if feedback is None else waiting.join(feedback, ["query", "id"], "left")
        waiting = known.withColumn("feedback", F.lit(0.0) if feedback is None else F.coalesce("feedback", F.lit(0.0)))
    return waiting.withColumn("band", band(order))


def new_paths(owned: DataFrame, r: int, n: int = 0) -> DataFrame:
    """query, src < dst and nodes of the simple ways between two seeds over a vertex that one of them came to own in round r; n: how many rows owned has."""
    a, b = (owned.select("query", "id", F.col("seed").alias(s), F.col("trail").alias(t), F.col("round").alias(f"{t}_round")) for s, t in (("src", "x"), ("dst", "y")))
    met = a.join(looped(b, n), ["query", "id"]).where((F.col("src") < F.col("dst")) & ((F.col("x_round") == r) | (F.col("y_round") == r)))
    joined = met.select("query", "src", "dst", F.concat("x", F.slice(F.reverse("y"), 2, F.size("y"))).alias("nodes"))
    return joined.where(F.size("nodes") == F.size(F.array_distinct("nodes"))).distinct()


def salience(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """paths with the geometric mean of 1 / ln(degree + 2) over their vertices, at most one."""
    each = paths.select("query", "src", "dst", "nodes", F.explode("nodes").alias("id")).join(facts.select("id", "degree"), "id", "left")
    logs = F.avg(-F.log(F.log(F.coalesce("degree", F.lit(0)) + F.lit(2.0))))
    return each.groupBy("query", "src", "dst", "nodes").agg(F.least(F.lit(1.0), F.exp(logs)).alias("salience"))


def feedback_of(paths: DataFrame, step: DataFrame, facts: DataFrame, order: str) -> DataFrame:
    """query, id and the feedback that paths give: the Jaccard similarity of a vertex's neighbours and a path, or its salience (half of it around the path)."""
    if order == "retrospective":
        each = paths.select("query", "nodes", F.explode("nodes").alias("u")).join(step, "u").groupBy("query", "nodes", F.col("v").alias("id")).agg(F.count("*").alias("both"))
        j = F.col("both") / (F.col("around") + F.size("nodes") - F.col("both"))
        degree = step.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("around"))
        return each.join(degree, "id").groupBy("query", "id").agg(F.max(j).alias("feedback"))
    each = paths.select("query", "nodes", "salience", F.explode("nodes").alias("u"))
    beside = each.join(step, "u").where(~F.array_contains("nodes", F.col("v"))).select("query", F.col("v").alias("id"), (F.col("salience") / 2).alias("feedback"))
    return each.select("query", F.col("u").alias("id"), F.col("salience").alias("feedback")).union(beside).groupBy("query", "id").agg(F.max("feedback").alias("feedback"))


def settled_queries(paths: DataFrame) -> DataFrame:
    """query of those whose paths (with round) are enough, diverse enough, and no longer gain salience."""
    ends = F.array_sort(F.collect_list(F.struct("round", "salience")))
    each = paths.groupBy("query").agg(F.count("*").alias("n"), F.slice(F.reverse(ends), 1, 2 * WINDOW).alias("last"))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, r: a + r["salience"]) / WINDOW
    late, early = mean(F.slice("last", 1, WINDOW)), mean(F.slice("last", WINDOW + 1, WINDOW))
    nodes = paths.select("query", F.explode("nodes").alias("id")).groupBy("query").agg((F.countDistinct("id") / F.count("*")).alias("diversity"))
    done = (F.col("n") >= MIN_PATHS) & (F.size("last") == 2 * WINDOW) & ((late - early) / early < PLATEAU) & (F.col("diversity") >= DIVERSITY)
    return each.join(nodes, "query").where(done).select("query")


def expand(graph: Graph, seeds: DataFrame, order: str = "degree", stop: str | None = None, delay: int = 0, scores: DataFrame | None = None, share: float = 0.8) -> DataFrame:
    """query, seed, id, parent, depth and round of all vertices that the seeds of each query come to own; seeds: query, seed.

    stop: None (nothing left to expand), `common` (all seeds own one vertex), `pairwise`
    (each two seeds share a vertex), `connected` (shared vertices connect all seeds),
    `coverage` (so large a share of all vertices is owned) or, of the adaptive order,
    `settled` (its paths are enough, diverse, and no longer gain); delay: rounds that a
    query goes on after that. A seed that is no vertex owns itself alone.
    """
    step = checkpointed(graph.adjacency().where("u <> v").distinct())
    facts = vertex_facts(graph, scores).withColumn("band", F.lit(0) if order in MOVING else band(order))
    facts = checkpointed(facts.select("id", "degree", "band"))
    n_vertices = facts.count()
    kind = seeds.schema["seed"].dataType
    owned = seeds.select("query", "seed", F.col("seed").alias("id"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("round")).distinct()
    start = owned.join(facts, "id", "left").na.fill(0, ["degree", "band"])
    if order in FEEDBACK:
        start = start.withColumn("trail", F.array("id"))
    queries = seeds.select("query").distinct().count()
    # Every round joins these: what it broadcasts passes through the driver, so only few rows are.
    step = looped(step, step.count())
    facts = looped(facts, n_vertices)
    rounds = _Rounds(start)
    n_open = rounds.owned_rows
    feedback: DataFrame | None = None
    found: DataFrame | None = None
    met: DataFrame | None = None
    while n_open:
        r = rounds.last + 1
        ranked = _ranked(rounds, step, order, feedback)
        ranked = checkpointed(ranked) if order in MOVING else ranked
        low = ranked.groupBy("query").agg(F.min("band").alias("low"))
        marked = ranked.join(sized(low, queries, 24), "query")
        trail = [F.concat("trail", F.array("v")).alias("trail")] if order in FEEDBACK else []
        reached = marked.where("band = low").join(step, F.col("id") == F.col("u")).select("query", "seed", F.col("v").alias("id"), F.struct((F.col("depth") + 1).alias("depth"), F.col("u").alias("parent"), *trail).alias("p"))
        fresh = reached.groupBy("query", "seed", "id").agg(F.min("p").alias("p")).join(looped(rounds.owned().select("query", "seed", "id"), rounds.owned_rows), ["query", "seed", "id"], "left_anti").join(facts, "id", "left")
        fresh = fresh.select("query", "seed", "id", "p.parent", "p.depth", F.lit(r).alias("round"), "degree", "band", *(["p.trail"] if trail else []))
        n_open = rounds.write(marked.where("band > low").select(fresh.columns).unionByName(fresh))
        if order in FEEDBACK:
            paths = checkpointed(salience(new_paths(rounds.owned(), r, rounds.owned_rows), facts).withColumn("round", F.lit(r)))
            found = paths if found is None else found.unionByName(paths)
            given = feedback_of(paths, step, facts, order)
            feedback, (k,) = measured(given if feedback is None else feedback.unionByName(given).groupBy("query", "id").agg(F.max("feedback").alias("feedback")), F.count("*"))
            feedback = looped(feedback, k)
        if stop:
            ended = settled_queries(found) if stop == "settled" and found is not None else stopped(rounds.owned(), seeds, stop, n_vertices, share)
            ended = ended.withColumn("at", F.lit(r))
            met = checkpointed(ended if met is None else met.unionByName(ended).groupBy("query").agg(F.min("at").alias("at")))
            over = met.where(F.col("at") + delay <= r).select("query")
            if n_open and not over.isEmpty():
                left = rounds.open().join(sized(over, queries, 16), "query", "left_anti")
                n_open = rounds.narrow(left)
    return rounds.owned().select("query", "seed", "id", "parent", "depth", "round")


def stopped(owned: DataFrame, seeds: DataFrame, rule: str, n_vertices: int, share: float = 0.8) -> DataFrame:
    """query of those that may stop by a rule."""
    n = seeds.groupBy("query").agg(F.countDistinct("seed").alias("n"))
    if rule == "common":
        return owned.groupBy("query", "id").agg(F.countDistinct("seed").alias("k")).join(n, "query").where("k = n AND n > 1").select("query").distinct()
    if rule == "coverage":
        return owned.groupBy("query").agg(F.countDistinct("id").alias("k")).where(F.col("k") >= share * n_vertices).select("query")
    met = overlaps(owned)
    if rule == "pairwise":
        return met.groupBy("query").agg(F.count("*").alias("k")).join(n, "query").where("2 * k = n * (n - 1)").select("query")
    return connected_queries(met, seeds)


def connected_queries(met: DataFrame, seeds: DataFrame) -> DataFrame:
    """query of those whose seeds the overlapping pairs connect; a single seed never is."""
    node = lambda c: F.concat_ws("\n", F.col("query").cast("string"), F.col(c).cast("string"))
    labels = min_labels(met.select(node("a").alias("a"), node("b").alias("b")))
    named = seeds.select("query", node("seed").alias("node")).join(labels, "node", "left").groupBy("query").agg(F.countDistinct(F.coalesce("label", "node")).alias("groups"), F.countDistinct("node").alias("n"))
    return named.where("groups = 1 AND n > 1").select("query")


def meetings(owned: DataFrame) -> DataFrame:
    """query, id and the seeds that own it, of vertices that several seeds of a query own."""
    return owned.groupBy("query", "id").agg(F.array_sort(F.collect_set("seed")).alias("seeds")).where(F.size("seeds") > 1)


def overlaps(owned: DataFrame) -> DataFrame:
    """query, seeds a < b and the number of vertices that both own."""
    pairs = F.filter(F.flatten(F.transform("seeds", lambda a: F.transform("seeds", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda x: x["a"] < x["b"])
    return meetings(owned).select("query", F.explode(pairs).alias("p")).groupBy("query", "p.a", "p.b").agg(F.count("*").alias("shared"))


def sphere_overlaps(owned: DataFrame, max_distance: int | None = None) -> DataFrame:
    """query, seeds a < b and the vertices of both that lie within the reach of the other's sphere (and within max_distance)."""
    radius = owned.groupBy("query", "seed").agg(F.max("depth").alias("radius"))
    a, b = (owned.join(radius, ["query", "seed"]).select("query", "id", F.col("seed").alias(x), F.col("depth").alias(f"d{x}"), F.col("radius").alias(f"r{x}")) for x in "ab")
    near = a.join(b, ["query", "id"]).where("a < b AND (da <= rb OR db <= ra)")
    if max_distance is not None:
        near = near.where((F.col("da") <= max_distance) & (F.col("db") <= max_distance))
    return near.groupBy("query", "a", "b").agg(F.count("*").alias("shared"))


def threshold_overlaps(owned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query, seeds a < b and the Jaccard similarity of what they own, from the threshold on."""
    size = owned.groupBy("query", "seed").agg(F.count("*").alias("k"))
    both = overlaps(owned).join(size.select("query", F.col("seed").alias("a"), F.col("k").alias("ka")), ["query", "a"]).join(size.select("query", F.col("seed").alias("b"), F.col("k").alias("kb")), ["query", "b"])
    return both.select("query", "a", "b", (F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold)


def meeting_paths(owned: DataFrame) -> DataFrame:
    """query, src < dst and nodes of the simple paths that join two seeds by their parents at a vertex both own, each once."""
    seen = checkpointed(owned.select("query", "seed", "id", "parent"))
    key = F.struct("query", F.col("seed").alias("seed"))
    parents = seen.select(key.alias("seed"), "id", "parent")
    back = checkpointed(walked_back(parents, seen.select(key.alias("src"), F.col("id").alias("dst"))).select("src.query", "src.seed", F.col("dst").alias("id"), "nodes"))
    a, b = back.select("query", "id", F.col("seed").alias("src"), F.col("nodes").alias("x")), back.select("query", "id", F.col("seed").alias("dst"), F.col("nodes").alias("y"))
    joined = a.join(b, ["query", "id"]).where("src < dst").select("query", "src", "dst", F.concat("x", F.slice(F.reverse("y"), 2, F.size("y"))).alias("nodes"))
    simple = joined.where(F.size("nodes") == F.size(F.array_distinct("nodes")))
    return simple.withColumn("s", signature(F.col("nodes"))).dropDuplicates(["query", "s"]).drop("s")


def salient_vertices(paths: DataFrame, share: float = 0.1, least: int = 10) -> DataFrame:
    """id and frequency of the vertices on most paths: that share of them, and so many at least, ties by id."""
    n = paths.select(F.explode(F.array_distinct("nodes")).alias("id")).groupBy("id").agg(F.count("*").alias("frequency"))
    keep = max(least, int(n.count() * share))
    return n.orderBy(F.desc("frequency"), "id").limit(keep)


def truncated(graph: Graph, owned: DataFrame) -> DataFrame:
    """id and component of owned vertices whose component, in the graph that the owned vertices induce, holds a meeting."""
    from meshwork.operators.traversal import components

    inside = graph.induced(owned.select("id").distinct())
    parts = checkpointed(components(Graph(inside.edges, owned.select("id").distinct(), graph.directed)))
    holds = parts.join(meetings(owned).select("id").distinct(), "id", "left_semi").select("component").distinct()
    return parts.join(holds, "component", "left_semi").select("id", "component")


def betweenness(graph: Graph, sources: DataFrame, normalised: bool = False) -> DataFrame:
    """id and the sum over sources of the share of shortest paths through it, by levels out and back.

    normalised divides by (n - 1)(n - 2), by half of it where the graph is undirected.
    """
    out = tiles.betweenness(graph, sources)
    if not normalised:
        return out
    n = graph.ids().count()
    most = (n - 1) * (n - 2) / (1 if graph.directed else 2)
    return out.withColumn("betweenness", F.col("betweenness") / F.lit(float(max(1, most))))
