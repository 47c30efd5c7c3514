"""Writers of edge lists, labels and incidence lists as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from .edges import canonical, symmetric


def write_undirected(edges: DataFrame, path: str, one_file: bool = False) -> None:
    """Both directions of each edge once, tab separated; in one file only if asked for, as one task then writes it."""
    both = symmetric(canonical(edges))
    (both.coalesce(1) if one_file else both).write.mode("overwrite").csv(path, sep="\t")


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("id", "label").write.mode("overwrite").csv(path, sep="\t")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.mode("overwrite").csv(path, sep="\t")


def numbered(edges: DataFrame) -> DataFrame:
    """Adds ``edge_id`` from 0 without gaps, in the order of (src, dst): counts per partition of a range, then offsets."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(edges.select("src", "dst").repartitionByRange(n, "src", "dst").withColumn("part", F.spark_partition_id()))
    # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("src", "dst"))
    return dealt.withColumn("at", within).join(F.broadcast(starts), "part").select("src", "dst", (F.col("start") + F.col("at") - 1).cast("long").alias("edge_id"))


def vertex_edge_ids(edges: DataFrame) -> DataFrame:
    """``id, edge_ids`` of each vertex, ascending."""
    ends = numbered(edges).select(F.explode(F.array("src", "dst")).alias("id"), "edge_id")
    return ends.groupBy("id").agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))


def write_vertex_edge_ids(edges: DataFrame, path: str) -> None:
    vertex_edge_ids(edges).select("id", F.array_join("edge_ids", " ")).write.mode("overwrite").csv(path, sep="\t")
