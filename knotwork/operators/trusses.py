"""k-trusses and truss decompositions, on triangles that are listed once, by parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import iterate
from .cores import k_core
from .incidence import relisted
from .peeling import peeled, refined
from .triangles import edge_support, triangle_edges, triangles


def _pruned(t: DataFrame, least: int) -> DataFrame:
    """Triangles without those that have an edge of lower support."""
    inc = triangle_edges(t)
    bad = inc.groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") < least).select("src", "dst")
    gone = inc.join(bad, ["src", "dst"], "left_semi").select("u", "v", "w").distinct()
    return t.join(gone, ["u", "v", "w"], "left_anti")


def _stable(a: DataFrame, b: DataFrame) -> bool:
    return (n := b.count()) == 0 or n == a.count()


def k_truss(edges: DataFrame, k: int, core_rounds: int | None = 1, max_iter: int | None = None, method: str = "triangles") -> DataFrame:
    """``src, dst, support``: the maximal subgraph in which every edge lies in k - 2 triangles at least.

    First ``core_rounds`` rounds towards the (k - 1)-core, which holds the k-truss (0: none, None: all). Method
    ``triangles`` lists the triangles once, by parts that keep and drop them; ``relist`` lists them anew from the edges
    left each round.
    """
    if k < 3:
        raise ValueError("a k-truss is defined for k >= 3 here")
    if method == "triangles" and max_iter is None and core_rounds in (None, 0, 1):
        return peeled(edges, k - 2, (k - 1) * (core_rounds != 0), core_rounds is None)
    if method == "relist":
        few = core_rounds in (0, 1)
        return relisted(edges if few else k_core(edges, k - 1, core_rounds), k - 2, core_rounds * (k - 1) if few else 0, max_iter)
    e = k_core(edges, k - 1, core_rounds)
    if max_iter is None:
        return peeled(e, k - 2)
    return edge_support(iterate(triangles(e), lambda t: _pruned(t, k - 2), _stable, max_iter))


def truss_levels(edges: DataFrame) -> DataFrame:
    """``src, dst, level, trussness`` of each edge in a triangle: level s is the largest support s such that the edge
    lies in the subgraph of edges with support s; trussness is level + 2. Parts refine all levels at once."""
    return refined(edges).withColumn("trussness", F.col("level") + 2)


def max_truss(edges: DataFrame) -> DataFrame:
    """The same as ``truss_levels`` by local refinement: an edge's value is the h-index, over its triangles, of the
    lesser value of the two other edges, from supports downwards until nothing changes."""
    return truss_levels(edges)


def truss_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count("*").alias("edges"))
