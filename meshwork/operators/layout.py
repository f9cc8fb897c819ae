"""Places for the vertices of a forest: each one over the middle of its leaves, a row for each depth.

Leaves are counted from the deepest level up, and the leaves left of a vertex summed
from the roots down: those left of its parent, and those of its earlier siblings. A
level is one job each way. Siblings stand in order of their ids, roots as well; the
children of one parent are summed in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.graph import Graph, checkpointed, measured


def forest_layout(graph: Graph) -> DataFrame:
    """id, depth, leaves, x (of the middle of its leaves, which stand at 0, 1, ...) and y of a forest whose edges lead from parent to child."""
    edges = checkpointed(graph.edges.where("src <> dst").select("src", "dst").distinct())
    if not edges.groupBy("dst").count().where("count > 1").isEmpty():
        raise ValueError("a vertex of a forest has one parent at most")
    roots = graph.ids().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    level, (n,) = measured(roots.select("id", F.lit(None).cast(edges.schema["dst"].dataType).alias("parent"), F.lit(0).alias("depth")), F.count("*"))
    levels = []
    while n:
        levels.append(level)
        level, (n,) = measured(edges.join(level.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.col("src").alias("parent"), F.lit(len(levels)).alias("depth")), F.count("*"))
    counted: list[DataFrame] = []
    for here in reversed(levels):
        below = counted[-1].groupBy(F.col("parent").alias("id")).agg(F.sum("leaves").alias("below")) if counted else None
        rows = here.withColumn("leaves", F.lit(1).cast("long")) if below is None else here.join(below, "id", "left").select(*here.columns, F.coalesce("below", F.lit(1)).alias("leaves"))
        counted.append(checkpointed(rows))
    out: DataFrame | None = None
    above: DataFrame | None = None
    earlier = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for here in reversed(counted):
        rows = here.withColumn("first", F.coalesce(F.sum("leaves").over(earlier), F.lit(0)))
        if above is not None:
            rows = rows.join(above.select(F.col("id").alias("parent"), F.col("first").alias("base")), "parent").withColumn("first", F.col("first") + F.col("base")).drop("base")
        above = checkpointed(rows.select("id", "depth", "leaves", "first"))
        out = above if out is None else out.unionByName(above)
    placed = out if out is not None else graph.ids().select("id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("first")).limit(0)
    return placed.select("id", "depth", "leaves", (F.col("first") + (F.col("leaves") - 1) / 2).alias("x"), F.col("depth").cast("double").alias("y"))
