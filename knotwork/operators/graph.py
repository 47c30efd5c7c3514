"""Neighbours, degrees and orientation of canonical edges (src < dst, each once)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.edges import symmetric


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``; aggregated before the shuffle, so hubs are no hot keys."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbor_list(edges: DataFrame) -> DataFrame:
    """``id, neighbors``, ascending. One row holds all of a vertex; the other operators stay with edges."""
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))


def before(d1: Column, v1: Column, d2: Column, v2: Column) -> Column:
    """The degree order: by degree, then by id."""
    return (d1 < d2) | ((d1 == d2) & (v1 < v2))


def orient(edges: DataFrame, by: str = "degree") -> DataFrame:
    """``src, dst, src_deg, dst_deg``, each edge from the earlier vertex of the order to the later. By degree no
    vertex has more than about sqrt(2 E) outgoing edges, whatever hubs there are; ``by="id"`` leaves the direction."""
    d = degrees(edges)
    both = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("d2")), "dst")
    keep = before(F.col("d1"), F.col("src"), F.col("d2"), F.col("dst")) if by == "degree" else F.col("src") < F.col("dst")
    pick = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    return both.select(pick("src", "dst").alias("src"), pick("dst", "src").alias("dst"), pick("d1", "d2").alias("src_deg"), pick("d2", "d1").alias("dst_deg"))


def higher_neighbors(edges: DataFrame) -> DataFrame:
    """``id, degree, higher``: each vertex with its later neighbours in order; those without any have an empty list."""
    o = orient(edges)
    lists = o.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dst_deg", "dst"))), lambda x: x["dst"]).alias("higher"))
    return degrees(edges).join(lists, "id", "left").select("id", "degree", F.coalesce("higher", F.array().cast("array<bigint>")).alias("higher"))
