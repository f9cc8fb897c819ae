"""Graphs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.graph import in_parts, meeting_items


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cite the parts on their lines."""
    return in_parts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), "src").distinct()


def cosupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on one order, smaller id first; w: orders they share."""
    return meeting_items(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", repeats=False).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("w"))


def strong(spark: SparkSession, sf_dir: str, share: float = 0.95) -> DataFrame:
    """The edges of cosupp heavier than the given quantile."""
    edges = cosupp(spark, sf_dir)
    cut = edges.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY w)").alias("cut"))
    return edges.join(F.broadcast(cut), F.col("w") > F.col("cut")).select("src", "dst", "w")  # one row is broadcast


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation; w: lines between them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    joined = joined.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive event types of one user; w: how often."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return steps.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("w"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and nation of every supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
