"""Inference of graph properties, and validation against a declared specification."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed
from meshwork.operators import communities, motifs, traversal
from meshwork.plans import classes


def properties(graph: Graph) -> DataFrame:
    """One row of counts that most predicates are read from."""
    n = graph.ids().agg(F.count("*").alias("vertices"))
    pair = F.struct("src", "dst") if graph.directed else F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    e = graph.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("int")), F.lit(0)).alias("loops"), F.countDistinct(pair).alias("distinct_pairs"))
    d = graph.degrees().agg(F.coalesce(F.min("degree"), F.lit(0)).alias("min_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum((F.col("degree") % 2).cast("int")), F.lit(0)).alias("odd_degrees"))
    row = n.join(F.broadcast(e)).join(F.broadcast(d))  # one row each
    possible = F.col("vertices") * (F.col("vertices") - 1.0) / (1 if graph.directed else 2)
    density = F.when(F.col("vertices") > 1, (F.col("distinct_pairs") - F.col("loops")) / possible).otherwise(0.0)
    return row.withColumns({
        "density": density, "simple": (F.col("loops") == 0) & (F.col("edges") == F.col("distinct_pairs")), "regular": F.col("min_degree") == F.col("max_degree"),
        "complete": density == 1, "eulerian_degrees": F.col("odd_degrees") == 0,
    })


def structure(graph: Graph) -> DataFrame:
    """One row: components, whether connected, a forest, a tree, bipartite, and the number of triangles."""
    graph = graph.stored()
    parts = checkpointed(traversal.components(graph))
    n = parts.agg(F.count("*").alias("vertices"), F.countDistinct("component").alias("components"))
    m = graph.edges.agg(F.count("*").alias("edges"))
    two = traversal.two_colouring(graph).agg(F.coalesce(F.min("bipartite"), F.lit(True)).alias("bipartite"))
    t = motifs.triangles(graph).agg(F.count("*").alias("triangles"))
    row = n.join(F.broadcast(m)).join(F.broadcast(two)).join(F.broadcast(t))  # one row each
    forest = F.col("edges") == F.col("vertices") - F.col("components")
    return row.select("vertices", "edges", "components", (F.col("components") <= 1).alias("connected"), forest.alias("forest"), (forest & (F.col("components") == 1)).alias("tree"), "bipartite", "triangles")


def attributes(graph: Graph) -> DataFrame:
    """One row on what the columns of vertices and edges say.

    weighting (none, unweighted where all are one, weighted), signedness, uncertainty
    (probability between 0 and 1), edge and vertex types, time (edge or vertex times),
    order of vertices (total where all differ, partial), layers, ports, roots.
    """
    e, columns = graph.edges, set(graph.edges.columns)
    on = lambda name, expr, other: F.coalesce(expr, F.lit(other)) if name in columns else F.lit(other)
    w = F.when(F.min("weight").isNull(), "none").when((F.min("weight") == 1) & (F.max("weight") == 1), "unweighted").otherwise("weighted") if "weight" in columns else F.lit("none")
    edge_row = e.agg(
        w.alias("weighting"), on("sign", F.when(F.min("sign") < 0, "signed"), "unsigned").alias("signedness"),
        on("probability", F.when((F.min("probability") >= 0) & (F.max("probability") <= 1), "probabilistic"), "certain").alias("uncertainty"),
        on("type", F.countDistinct("type").cast("long"), 0).cast("long").alias("edge_types"), on("time", F.when(F.count("time") > 0, "temporal_edges"), "static").alias("edge_time"), on("port", F.when(F.count("port") > 0, "ports"), "none").alias("ports"),
    )
    if graph.vertices is None:
        return edge_row.select("*", F.lit(0).cast("long").alias("vertex_types"), F.lit("distinguishable").alias("identity"), F.lit("unordered").alias("ordering"), F.lit("none").alias("layers"), F.lit(0).cast("long").alias("roots"), F.lit("static").alias("vertex_time"))
    v, columns = graph.vertices, set(graph.vertices.columns)
    order = F.when(F.count("order") < F.count("*"), "unordered").when(F.countDistinct("order") == F.count("*"), "total").otherwise("partial") if "order" in columns else F.lit("unordered")
    vertex_row = v.agg(
        on("type", F.countDistinct("type").cast("long"), 0).cast("long").alias("vertex_types"), F.when(F.countDistinct("id") == F.count("*"), "distinguishable").otherwise("indistinguishable").alias("identity"), order.alias("ordering"),
        on("layer", F.when(F.count("layer") > 0, "layered"), "none").alias("layers"), on("root", F.sum(F.col("root").cast("long")) if "root" in columns else None, 0).cast("long").alias("roots"), on("time", F.when(F.count("time") > 0, "temporal_vertices"), "static").alias("vertex_time"),
    )
    return edge_row.join(F.broadcast(vertex_row))  # one row each


def direction(graph: Graph) -> DataFrame:
    """One row: edges whose reverse exists, and whether every edge has one (bidirected), some have (mixed) or none has (antisymmetric)."""
    plain = graph.edges.where("src <> dst").select("src", "dst").distinct()
    back = plain.join(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count("*").alias("mutual"))
    row = plain.agg(F.count("*").alias("arcs")).join(F.broadcast(back))  # one row each
    name = F.when(F.lit(not graph.directed), "undirected").when(F.col("mutual") == 0, "antisymmetric").when(F.col("mutual") == F.col("arcs"), "bidirected").otherwise("mixed")
    return row.select("mutual", name.alias("directionality"))


def is_acyclic(graph: Graph) -> bool:
    """Directed: every vertex gets a topological level. Undirected: a forest without loops and parallel edges."""
    if graph.directed:
        return traversal.topological_levels(graph).where("level IS NULL").isEmpty()
    row = structure(Graph(graph.edges, graph.vertices)).first()
    return bool(row.forest)


def is_tournament(graph: Graph) -> bool:
    row = properties(graph).first()
    return graph.directed and row.loops == 0 and row.edges == row.distinct_pairs == row.vertices * (row.vertices - 1) // 2 and direction(graph).first().mutual == 0


def is_complete_bipartite(graph: Graph) -> bool:
    """Two sides, found by parity from one vertex, with an edge for each pair across."""
    g = graph.undirected()
    row = structure(g).first()
    if not row.bipartite or row.components != 1:
        return False
    seed = g.ids().agg(F.min("id").alias("id"))
    odd = traversal.levels(g, seed).where("hops % 2 = 1").count()
    return row.edges == odd * (row.vertices - odd)


def flow_faults(graph: Graph, source: object, sink: object, capacity: str = "capacity") -> DataFrame:
    """What keeps a directed graph from being a flow network: kind and number of edges or vertices at fault, none if it is one."""
    e = graph.edges.select("src", "dst", F.col(capacity).alias("c"))
    bad = [e.where("c IS NULL OR c < 0").agg(F.count("*").alias("n")).select(F.lit("capacity").alias("fault"), "n"), e.where(F.col("dst") == F.lit(source)).agg(F.count("*").alias("n")).select(F.lit("edge into the source").alias("fault"), "n"), e.where(F.col("src") == F.lit(sink)).agg(F.count("*").alias("n")).select(F.lit("edge out of the sink").alias("fault"), "n")]
    spark = e.sparkSession
    to = lambda x: spark.createDataFrame([(x,)], graph.edges.select(F.col("src").alias("id")).schema)
    forth = traversal.levels(graph, to(source)).select("id")
    back = traversal.levels(Graph(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), None, True), to(sink)).select("id")
    lost = graph.ids().join(forth.join(back, "id", "left_semi"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("vertex on no way").alias("fault"), "n")
    return reduce(DataFrame.union, [*bad, lost]).where("n > 0")


def small_world(graph: Graph) -> DataFrame:
    """One row: clustering and mean distance against those expected of a random graph of the size, and whether it is a small world."""
    row = classes.features(graph).join(F.broadcast(classes.distances_row(graph)))  # one row each
    n, k = F.col("vertices"), F.col("mean_degree")
    random_clustering, random_distance = k / n, F.log(n.cast("double")) / F.log(k)
    sigma = (F.col("mean_clustering") / random_clustering) / (F.col("mean_distance") / random_distance)
    return row.select("mean_clustering", "mean_distance", sigma.alias("sigma"), F.coalesce(sigma > 1, F.lit(False)).alias("small_world"))


def community_structure(graph: Graph, least: float = 0.3) -> DataFrame:
    """One row: communities and modularity of the Leiden division, and whether that is modular."""
    found = checkpointed(communities.leiden(graph))
    q = communities.modularity(graph, found)
    return found.agg(F.countDistinct("community").alias("communities")).join(F.broadcast(q)).select("communities", "modularity", F.coalesce(F.col("modularity") > least, F.lit(False)).alias("modular"))  # one row each


def _row(frame: Callable[[Graph], DataFrame]) -> Callable[[Graph], dict]:
    return lambda g: frame(g).first().asDict()


def _named(name: str, test: Callable[[Graph], object]) -> Callable[[Graph], dict]:
    return lambda g: {name: test(g)}


def _sums(g: Graph) -> dict:
    """Predicates that follow from the counts."""
    p, s = properties(g).first().asDict(), structure(g.undirected()).first().asDict()
    n, d = p["vertices"], p["density"]
    return {
        "eulerian": s["connected"] and p["odd_degrees"] == 0, "semi_eulerian": s["connected"] and p["odd_degrees"] == 2, "star": s["tree"] and (n <= 2 or p["max_degree"] == n - 1), "cubic": p["regular"] and p["max_degree"] == 3,
        "sparse": d <= 0.1, "dense": d >= 0.7, "multigraph": p["edges"] > p["distinct_pairs"], "self_loops": p["loops"] > 0, "degree": p["max_degree"] if p["regular"] else None,
        "triangle_free": s["triangles"] == 0, "planar_by_edges": n < 3 or s["edges"] <= 3 * n - 6,
    }


def _free(name: str) -> Callable[[Graph], bool]:
    return lambda g: classes.is_free_of(g, [name])


def _counted(g: Graph) -> dict[str, bool]:
    """Both from one count of the small patterns."""
    counts = motifs.induced_counts(g)
    return {"cograph": counts["P4"] == 0, "claw_free": counts["claw"] == 0}


def _threshold(g: Graph) -> bool:
    return bool(classes.is_split(g).first().split) and classes.is_free_of(g, ["P4"])


def _ptolemaic(g: Graph) -> bool:
    return classes.is_chordal(g) and classes.is_free_of(g, ["gem"])


#: Where each property is found: (names, how a row of them is computed). Only what is asked for is computed.
SOURCES: list[tuple[tuple[str, ...], Callable[[Graph], dict]]] = [
    (("vertices", "edges", "loops", "distinct_pairs", "min_degree", "max_degree", "odd_degrees", "density", "simple", "regular", "complete", "eulerian_degrees"), _row(properties)),
    (("components", "connected", "forest", "tree", "bipartite", "triangles"), _row(structure)),
    (("eulerian", "semi_eulerian", "star", "cubic", "sparse", "dense", "multigraph", "self_loops", "degree", "triangle_free", "planar_by_edges"), _sums),
    (("weighting", "signedness", "uncertainty", "edge_types", "edge_time", "ports", "vertex_types", "identity", "ordering", "layers", "roots", "vertex_time"), _row(attributes)),
    (("mutual", "directionality"), _row(direction)),
    (("directed",), _named("directed", lambda g: g.directed)),
    (("acyclic",), _named("acyclic", is_acyclic)),
    (("dag",), _named("dag", lambda g: g.directed and is_acyclic(g))),
    (("tournament",), _named("tournament", is_tournament)),
    (("complete_bipartite",), _named("complete_bipartite", is_complete_bipartite)),
    (("split",), _row(classes.is_split)),
    (("cograph", "claw_free"), _counted),
    (("threshold",), _named("threshold", _threshold)),
    (("chordal",), _named("chordal", classes.is_chordal)),
    (("ptolemaic",), _named("ptolemaic", _ptolemaic)),
    (("distance_hereditary",), _named("distance_hereditary", classes.is_distance_hereditary)),
    (("bull_free",), _named("bull_free", _free("bull"))),
    (("gem_free",), _named("gem_free", _free("gem"))),
    (("p5_free",), _named("p5_free", _free("P5"))),
    (("c5_free",), _named("c5_free", _free("C5"))),
    (("strongly_regular", "k", "lambda", "mu"), _row(classes.strongly_regular)),
    (("diameter", "radius", "mean_distance"), _row(classes.distances_row)),
    (("girth",), _row(classes.girth)),
    (("slope", "fit", "scale_free"), _row(classes.degree_law)),
    (("mean_clustering", "transitivity"), _row(classes.clustering_row)),
    (("assortativity",), _row(classes.assortativity)),
    (("small_world", "sigma"), _row(small_world)),
    (("modular", "communities", "modularity"), _row(community_structure)),
    (("colours",), _named("colours", lambda g: (classes.greedy_colours(g).agg(F.max("colour")).first()[0] or 0) + 1)),
    (("spectral_radius",), _named("spectral_radius", lambda g: round(classes.spectral_radius(g), 4))),
    (("algebraic_connectivity",), _named("algebraic_connectivity", lambda g: round(classes.algebraic_connectivity(g), 4))),
]


def inferred(graph: Graph, names: list[str]) -> dict[str, object]:
    """The named properties of a graph; unknown names are absent."""
    g, out = graph.stored(), {}
    for known, find in SOURCES:
        if set(known) & set(names):
            out |= {k: v for k, v in find(g).items() if k in names}
    return out


def _told(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def validate(graph: Graph, declared: dict[str, object]) -> DataFrame:
    """property, expected, actual, valid and message of each declared property; unknown names are reported as such."""
    found = inferred(graph, list(declared))
    rows = []
    for name, expected in declared.items():
        actual = _told(found[name]) if name in found else "unknown"
        valid = actual == _told(expected)
        rows.append((name, _told(expected), actual, valid, "" if valid else f"{name} is {actual}, declared as {_told(expected)}"))
    return graph.edges.sparkSession.createDataFrame(rows, "property string, expected string, actual string, valid boolean, message string")
