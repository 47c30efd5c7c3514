"""Connected components of links between long ids, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for each id in ``links`` (a, b): root is the smallest id reachable.

    Large-star links each larger neighbour to the smallest neighbour, small-star each smaller one; both keep the
    components, and alternate until only stars are left, a logarithmic number of rounds. Every round is written to
    the shared folder, and the one before deleted. Self-links and repeated links don't matter. No links: no rows.
    """
    own, n = Scratch(links.sparkSession), 0
    edges = own.write(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"links-{n}")
    before = None
    while before != (now := _digest(edges)):
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        n += 1
        edges = own.write(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), f"links-{n}")
        own.delete(f"links-{n - 1}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
