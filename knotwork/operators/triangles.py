"""Wedges, triangles and what is counted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import before
from .listing import listed, listed_by_degree


def wedges(oriented: DataFrame) -> DataFrame:
    """``u, v, w``: open wedges from the earliest vertex u, v before w."""
    a, b = oriented.alias("a"), oriented.alias("b")
    later = before(F.col("a.dst_deg"), F.col("a.dst"), F.col("b.dst_deg"), F.col("b.dst"))
    return a.join(b, F.col("a.src") == F.col("b.src")).filter(later).select(F.col("a.src").alias("u"), F.col("a.dst").alias("v"), F.col("b.dst").alias("w"))


def triangles(edges: DataFrame, by: str = "degree") -> DataFrame:
    """``u, v, w`` in the order, each triangle once: wedges that an edge from v to w closes."""
    return listed_by_degree(edges) if by == "degree" else listed(edges)


def triangle_edges(t: DataFrame) -> DataFrame:
    """``src, dst, apex`` and the triangle: three rows for each, ``src < dst``."""
    pair = lambda x, y, z: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.col(z).alias("apex"))
    return t.select("u", "v", "w", F.explode(F.array(pair("u", "v", "w"), pair("u", "w", "v"), pair("v", "w", "u"))).alias("e")).select("e.*", "u", "v", "w")


def vertex_triangles(t: DataFrame) -> DataFrame:
    """``id, triangles`` of vertices in at least one."""
    return t.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def edge_support(t: DataFrame) -> DataFrame:
    """``src, dst, support`` of edges in at least one triangle."""
    return triangle_edges(t).groupBy("src", "dst").agg(F.count("*").alias("support"))


def apex_sets(t: DataFrame) -> DataFrame:
    """``src, dst, support, apexes``: the third vertices of each edge's triangles."""
    return triangle_edges(t).groupBy("src", "dst").agg(F.count("*").alias("support"), F.array_sort(F.collect_list("apex")).alias("apexes"))


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row, ``triangles``; 0 if there are none."""
    return triangles(edges).agg(F.count("*").alias("triangles"))
