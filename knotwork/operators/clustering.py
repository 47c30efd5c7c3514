"""Clustering coefficients and graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degrees
from .triangles import triangle_count, triangles, vertex_triangles


def local_cc(edges: DataFrame) -> DataFrame:
    """``id, degree, triangles, lcc`` of all vertices: 2 t / (d (d - 1)), 0 below degree 2 or without triangles."""
    both = degrees(edges).join(vertex_triangles(triangles(edges)), "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    d = F.col("degree").cast("double")
    return both.withColumn("lcc", F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (d * (d - 1.0))))


def average_lcc(edges: DataFrame) -> DataFrame:
    """One row, ``avg_lcc`` over all vertices, rounded to 9 places; 0 for no vertices."""
    return local_cc(edges).agg(F.round(F.coalesce(F.avg("lcc"), F.lit(0.0)), 9).alias("avg_lcc"))


def global_cc(edges: DataFrame) -> DataFrame:
    """One row: ``vertices, triangles, global_cc``, the triangles over n (n - 1); 0 below two vertices."""
    n = degrees(edges).agg(F.count("*").alias("vertices"))
    v = F.col("vertices").cast("double")
    return n.crossJoin(triangle_count(edges)).withColumn("global_cc", F.when(F.col("vertices") < 2, 0.0).otherwise(F.col("triangles") / (v * (v - 1.0))))


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: ``wedges, triangles, transitivity``, three times the triangles over all wedges; 0 without wedges."""
    w = degrees(edges).agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).alias("wedges"))
    return w.crossJoin(triangle_count(edges)).withColumn("transitivity", F.when(F.col("wedges") == 0, 0.0).otherwise(3.0 * F.col("triangles") / F.col("wedges")))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, edges a vertex, average degree and its whole part, largest degree, triangles and
    average local coefficient."""
    l = local_cc(edges)
    s = l.agg(
        F.count("*").alias("vertices"),
        (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_deg"),
        (F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("triangles"),
        F.round(F.coalesce(F.avg("lcc"), F.lit(0.0)), 9).alias("avg_lcc"),
    )
    some = F.col("vertices") > 0
    return s.select(
        "vertices",
        "edges",
        F.when(some, F.round(F.col("edges") / F.col("vertices"), 9)).otherwise(0.0).alias("edges_per_vertex"),
        F.when(some, F.round(2.0 * F.col("edges") / F.col("vertices"), 9)).otherwise(0.0).alias("avg_deg"),
        F.when(some, F.expr("2 * edges div vertices")).otherwise(0).cast("long").alias("avg_deg_floor"),
        "max_deg",
        "triangles",
        "avg_lcc",
    )


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("vertices"))
