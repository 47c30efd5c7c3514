"""Graph partitioning by seeded label propagation, merging of small parts, and measures of a partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import Generations, written
from ..sources.edges import symmetric
from .graph import degrees


def part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("pid").agg(F.count("*").alias("vertices"))


def _seeds(all_degrees: DataFrame, parts: list[int], ignore_highest: int, seed: int) -> DataFrame:
    """``id, pid, power``: the vertices of the degree band below the ``ignore_highest`` highest distinct degrees, wide
    enough to hold one vertex for each part, each with one of the parts by hash."""
    n_parts = len(parts)
    by_degree = all_degrees.groupBy("degree").agg(F.count("*").alias("n")).orderBy(F.desc("degree"))
    counts = [(r["degree"], r["n"]) for r in by_degree.collect()]  # one row for each distinct degree
    band, got = counts[min(ignore_highest, max(0, len(counts) - 1)) :], 0
    low = high = band[0][0] if band else 0
    for degree, n in band:
        low, got = degree, got + n
        if got >= n_parts:
            break
    pid = F.get(F.array(*map(F.lit, parts)), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n_parts)).cast("int"))
    return all_degrees.filter(F.col("degree").between(low, high)).select("id", pid.alias("pid"), F.lit(1.0).alias("power"))


def seeds(edges: DataFrame, n_parts: int, ignore_highest: int = 1, seed: int = 0) -> DataFrame:
    """The first seeds of ``power_partitions``."""
    return _seeds(degrees(edges), list(range(n_parts)), ignore_highest, seed)


def power_partitions(edges: DataFrame, n_parts: int, ignore_highest: int = 1, seed: int = 0, max_iter: int | None = None) -> DataFrame:
    """``id, pid`` for every vertex. Placed vertices send their part and power to their neighbours; a vertex without a
    part takes that of the greatest summed power among parts of less than average size, of equal ones the lowest.
    When nothing moves, vertices without a part of the highest degrees among these become seeds of parts of less than
    average size. Once fewer are left than there are leaves, or every part has the average size, the rest goes to a part
    by a hash weighted by the parts' room; so does what ``max_iter`` rounds leave, if given."""
    both, all_ = written(symmetric(edges)), written(degrees(edges))
    total, leaves = all_.count(), all_.filter("degree = 1").count()
    average = max(1, total // n_parts)
    kept = Generations(edges.sparkSession)
    placed = kept.write(seeds(edges, n_parts, ignore_highest, seed))
    fresh, rounds = placed, 0
    while max_iter is None or rounds < max_iter:
        rounds += 1
        sizes = {r["pid"]: r["vertices"] for r in part_sizes(placed).collect()}  # one row a part
        open_ = [p for p in range(n_parts) if sizes.get(p, 0) < average]
        left = total - sum(sizes.values())
        if not open_ or left == 0 or left < leaves:
            break
        sent = both.join(fresh.filter(F.col("pid").isin(open_)).select(F.col("id").alias("src"), "pid", "power"), "src").join(placed.select(F.col("id").alias("dst")), "dst", "left_anti")
        power = sent.groupBy(F.col("dst").alias("id"), "pid").agg(F.sum("power").alias("power"))
        best = power.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("power"), "pid"))).filter("r = 1")
        fresh = written(best.select("id", "pid", (F.col("power") / 2).alias("power")))
        if fresh.isEmpty():
            fresh = written(_seeds(all_.join(placed, "id", "left_anti"), open_, 0, seed + rounds))
        placed = kept.write(placed.unionByName(fresh))
    sizes = {r["pid"]: r["vertices"] for r in part_sizes(placed).collect()}
    room = [max(0, average + 1 - sizes.get(p, 0)) for p in range(n_parts)]
    bounds, run = [], 0
    for r in room:
        run += r
        bounds.append(run)
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(max(1, run)))
    pick = F.least(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= draw)), F.lit(n_parts - 1))
    rest = all_.join(placed, "id", "left_anti").select("id", pick.cast("int").alias("pid"))
    return placed.select("id", "pid").unionByName(rest)


def _mapped(parts: DataFrame, to: dict[int, int]) -> DataFrame:
    """One small row a part, so the map is bounded by the number of parts."""
    table = parts.sparkSession.createDataFrame(sorted(to.items()) or [(0, 0)], "pid int, to int")
    return parts.join(F.broadcast(table), "pid").select("id", F.col("to").alias("pid"))


def merge_small(parts: DataFrame, capacity: int) -> DataFrame:
    """Joins parts in order of their number; a new one begins where the running size would pass the capacity."""
    to, now, size = {}, 0, 0
    for r in part_sizes(parts).orderBy("pid").collect():
        if size and size + r["vertices"] > capacity:
            now, size = now + 1, 0
        to[r["pid"]] = now
        size += r["vertices"]
    return _mapped(parts, to)


def part_links(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``p1, p2, edges`` between different parts, p1 < p2."""
    a, b = parts.select(F.col("id").alias("src"), F.col("pid").alias("a")), parts.select(F.col("id").alias("dst"), F.col("pid").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a <> b").groupBy(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2")).agg(F.count("*").alias("edges"))


def hierarchical_partitions(edges: DataFrame, n_parts: int, factor: int = 4, seed: int = 0) -> DataFrame:
    """``id, pid``: a finer partitioning of ``n_parts * factor`` parts, whose smallest part is joined to the neighbour
    it has most edges to, within the average size if one can, until ``n_parts`` are left."""
    fine = written(power_partitions(edges, n_parts * factor, seed=seed))
    sizes = {r["pid"]: r["vertices"] for r in part_sizes(fine).collect()}
    links: dict[int, dict[int, int]] = {p: {} for p in sizes}
    for r in part_links(edges, fine).collect():  # at most a row for each pair of parts
        links[r["p1"]][r["p2"]] = links[r["p2"]][r["p1"]] = r["edges"]
    to, average = {p: p for p in sizes}, sum(sizes.values()) / max(1, n_parts)
    while len(sizes) > n_parts:
        small = min(sizes, key=lambda p: (sizes[p], p))
        others = [p for p in sizes if p != small]
        best = max(others, key=lambda p: (sizes[p] + sizes[small] <= 1.1 * average, links[small].get(p, 0), -sizes[p], -p))
        sizes[best] += sizes.pop(small)
        for p, n in links.pop(small).items():
            links[p].pop(small, None)
            if p != best:
                links[best][p] = links[p][best] = links[best].get(p, 0) + n
        to = {p: best if t == small else t for p, t in to.items()}
    number = {p: i for i, p in enumerate(sorted(set(to.values())))}
    return _mapped(fine, {p: number[t] for p, t in to.items()})


def hash_partitions(edges: DataFrame, n_parts: int) -> DataFrame:
    """``id, pid`` by id modulo: the plain baseline."""
    return degrees(edges).select("id", F.pmod("id", F.lit(n_parts)).cast("int").alias("pid"))


def cut_cost(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: ``cut``, the edges between parts, and ``half_cut``, half of it rounded down."""
    return part_links(edges, parts).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("cut")).select("cut", F.expr("cut div 2").alias("half_cut"))


def balance(parts: DataFrame) -> DataFrame:
    """One row: ``parts, vertices, largest, deviation``, the mean distance of sizes from the average."""
    s = part_sizes(parts)
    mean = s.agg(F.count("*").alias("parts"), F.sum("vertices").alias("total"), F.max("vertices").alias("largest"))
    return s.crossJoin(mean).groupBy("parts", "total", "largest").agg(F.round(F.avg(F.abs(F.col("vertices") - F.col("total") / F.col("parts"))), 6).alias("deviation")).select("parts", F.col("total").alias("vertices"), "largest", "deviation")
