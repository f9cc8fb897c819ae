"""Degrees of a growing edge stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame) -> DataFrame:
    """id and degree of a streaming (or static) edge DataFrame with src and dst; write it in update mode."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
