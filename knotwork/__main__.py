"""Command line: ``python -m knotwork TOOL EDGES [options]``; EDGES is a text file or folder of edges."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .config import PatternSettings
from .operators import clustering, cores, graph, partitioning, patterns, triangles, trusses
from .plans.fixpoint import written
from .plans.patterns import SAMPLES, read_query
from .sources import edges as source
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork", description=__doc__)
    p.add_argument("--master", help="as of spark-submit; by default what the session says")
    p.add_argument("--partitions", type=int, help="shuffle partitions")
    p.add_argument("--out", help="folder for the result as Parquet; by default its first rows are shown")
    tools = p.add_subparsers(dest="tool", required=True)

    def tool(name: str, **options: tuple) -> None:
        t = tools.add_parser(name)
        t.add_argument("edges")
        for option, (kind, default) in options.items():
            t.add_argument(f"--{option.replace('_', '-')}", type=kind, default=default)

    for name in ("stats", "triangles", "triangle-count", "local-cc", "global-cc", "transitivity", "core-numbers", "undirect", "vertex-edges"):
        tool(name)
    tool("k-core", k=(int, 2), max_iter=(int, 10))
    tool("max-core", start=(int, 2), step=(int, 10))
    tool("k-truss", k=(int, 4), core_rounds=(int, 1000), max_iter=(int, 1000))
    tool("max-truss")
    tool("truss-levels")
    tool("partition", parts=(int, 8), seed=(int, 0))
    tool("label", labels=(str, "A B C D E"), seed=(int, 0))
    tool("index", labels=(str, None), to=(str, "index"))
    tool("search", labels=(str, None), query=(str, "q1"), settings=(str, None))
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    raw = source.edges_from_text(spark, a.edges)
    e = written(source.canonical(raw))
    labels = lambda: source.with_labels(graph.vertices(e), source.labels_from_text(spark, a.labels) if a.labels else None)
    match a.tool:
        case "k-core":
            return cores.k_core(e, a.k, a.max_iter)
        case "max-core":
            return cores.max_core(e, a.start, a.step)
        case "k-truss":
            return trusses.k_truss(e, a.k, a.core_rounds, a.max_iter)
        case "partition":
            return partitioning.power_partitions(e, a.parts, seed=a.seed)
        case "label":
            return source.random_labels(graph.vertices(e), a.labels.split(), a.seed)
        case "index":
            patterns.write_index(e, labels(), a.to)
            return None
        case "search":
            if a.settings:
                a.query = PatternSettings.of(open(a.settings).read()).query_sample
            q = SAMPLES[a.query] if a.query in SAMPLES else read_query(open(a.query).read())
            return patterns.count_embeddings(e, labels(), q)
        case "undirect":
            sinks.write_undirected(raw, a.out or "undirected")
            return None
        case _:
            plain = {
                "stats": clustering.graph_stats, "triangles": triangles.triangles, "triangle-count": triangles.triangle_count, "local-cc": clustering.local_cc, "global-cc": clustering.global_cc, "transitivity": clustering.transitivity,
                "core-numbers": cores.core_numbers, "max-truss": trusses.max_truss, "truss-levels": trusses.truss_levels, "vertex-edges": sinks.vertex_edge_ids,
            }
            return plain[a.tool](e)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    builder = SparkSession.builder.appName(f"knotwork {a.tool}")
    if a.master:
        builder = builder.master(a.master)
    if a.partitions:
        builder = builder.config("spark.sql.shuffle.partitions", a.partitions)
    spark, began = builder.getOrCreate(), time.perf_counter()
    df = result(spark, a)
    if df is not None and a.out:
        df.write.mode("overwrite").parquet(a.out)
    elif df is not None:
        df.show(50, truncate=False)
    print(f"{a.tool}: {time.perf_counter() - began:.1f} s")


if __name__ == "__main__":
    main()
