"""Labelled pattern search: the index of stars, embeddings by joins, and stars by label."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from ..plans.patterns import Query, Slice
from ..sources.edges import symmetric
from .graph import before, degrees
from .linked import linked_count, sides
from .listing import listed
from .stars import stars
from .triangles import triangles, vertex_triangles


def labelled_edges(edges: DataFrame, labels: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """Both directions of each edge with label and degree of both ends and, of the source, the number of triangles in
    which it is the earliest (``tc``)."""
    d = degrees(edges).join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit("_")))
    if low is not None:
        d = d.join(low, "id", "left").withColumn("tc", F.coalesce("tc", F.lit(0)))
    end = lambda p, *cols: d.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    more = ["tc"] if low is not None else []
    return symmetric(edges).join(end("src", "label", "degree", *more), "src").join(end("dst", "label", "degree"), "dst")


def lowest_counts(t: DataFrame) -> DataFrame:
    """``id, tc``: triangles in which the vertex is the earliest."""
    return t.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("tc"))


def _fits(query: Query, v: int, label: Column, degree: Column) -> Column:
    return (label == query.labels[v]) & (degree >= query.degree(v))


def _all_fit(edges: DataFrame, labels: DataFrame, label: str) -> bool:
    """Whether each vertex has the label; one without any has the default."""
    known = degrees(edges).select("id").join(labels.select("id", "label"), "id", "left")
    return known.groupBy("id").agg(F.bool_or(F.coalesce("label", F.lit("_")) == label).alias("fits")).filter("not fits").isEmpty()


def embeddings(edges: DataFrame, labels: DataFrame, query: Query) -> DataFrame:
    """One row for each way to map the pattern into the graph: a column ``v<i>`` for each of its vertices, distinct,
    with the vertex's label, and an edge for each of the pattern's edges (further edges may exist).

    The plan joins one pattern vertex after another, each on all edges that tie it to those before: the first is a
    scan of edges, the others are equi-joins on one or, where they close a cycle, two columns. Labels and degrees
    are filtered before any join. A triangle of one label that all vertices have is no join: its embeddings are the
    listed triangles, each in six ways.
    """
    if len(query.labels) == len(query.edges) == 3 and len(one := set(query.labels.values())) == 1 and _all_fit(edges, labels, *one):
        ways = F.array(*(F.struct(*(F.col(c).alias(f"v{v}") for c, v in zip(way, query.vertices))) for way in permutations("uvw")))
        return triangles(edges).select(F.explode(ways).alias("m")).select("m.*")
    e = written(labelled_edges(edges, labels))
    first, *rest = query.order()
    out: DataFrame | None = None
    placed = [first]
    for v in rest:
        ties = [u for u in placed if query.joined(u, v)]
        step = lambda u, v=v: e.filter(_fits(query, u, F.col("src_label"), F.col("src_degree")) & _fits(query, v, F.col("dst_label"), F.col("dst_degree"))).select(F.col("src").alias(f"v{u}"), F.col("dst").alias(f"v{v}"))
        if out is None:
            out = step(first)
        else:
            out = out.join(step(ties[0]), f"v{ties[0]}")
        for u in ties[1:]:
            out = out.join(step(u), [f"v{u}", f"v{v}"])
        apart = [F.col(f"v{u}") != F.col(f"v{v}") for u in placed if u not in ties and query.labels[u] == query.labels[v]]
        out = out.filter(reduce(lambda a, b: a & b, apart)) if apart else out
        placed.append(v)
    assert out is not None
    return out.select(*(f"v{v}" for v in query.vertices))


def _loose(query: Query) -> int | None:
    """A vertex of one edge whose choices one number tells: all of its label but the other end are joined to that end."""
    for v in query.vertices:
        if len(query.edges) > 1 and query.degree(v) == 1:
            (tie,) = query.near(v)
            if all(u in (v, tie) or query.joined(u, tie) for u in query.vertices if query.labels[u] == query.labels[v]):
                return v
    return None


def count_embeddings(edges: DataFrame, labels: DataFrame, query: Query) -> DataFrame:
    """One row, ``embeddings``. A vertex of one edge makes no rows where the others' count by its neighbour and the number
    of fitting neighbours, without those taken, tell how many there are. Two triangles that two edges link are counted by
    parts, if no vertex has two of their labels."""
    if (found := sides(query)) is not None and labels.filter(F.col("label").isin(*found)).groupBy("id").agg(F.count_distinct("label").alias("n")).filter("n > 1").isEmpty():
        return linked_count(edges, labels, found)
    if (v := _loose(query)) is not None:
        (tie,) = query.near(v)
        label = query.labels[v]
        rest = Query(frozenset(x for x in query.edges if v not in x), {u: x for u, x in query.labels.items() if u != v})
        taken = sum(query.labels[u] == label for u in query.near(tie) - {v})
        if _all_fit(edges, labels, label):
            near = degrees(edges).withColumnRenamed("degree", "choices")
        else:
            fitting = degrees(edges).join(labels.select("id", "label"), "id", "left").filter(F.coalesce("label", F.lit("_")) == label).select(F.col("id").alias("dst"))
            near = symmetric(edges).join(fitting, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("choices"))
        found = embeddings(edges, labels, rest).groupBy(F.col(f"v{tie}").alias("id")).agg(F.count("*").alias("n")).join(near, "id")
        return found.agg(F.coalesce(F.sum(F.col("n") * (F.col("choices") - taken)), F.lit(0)).alias("embeddings"))
    return embeddings(edges, labels, query).agg(F.count("*").alias("embeddings"))


def slice_matches(edges: DataFrame, labels: DataFrame, query: Query, s: Slice) -> DataFrame:
    """Embeddings of one star whose anchor comes before the other vertices in the data's degree order too.

    A pair of the star's later neighbours is a triangle that the anchor comes first in. So only edges between vertices
    that fit are kept, before any triangle is listed, and pairs are joined from the anchor's triangles: no wedge is a row.
    A vertex goes by its id and, in the lowest bits, the positions that it fits; ids must leave room for these (an error
    else). Several labels of a vertex: it fits with any, and a match is one row.
    """
    at = (s.anchor, *s.higher)
    place = {v: i for i, v in enumerate(at)}
    has = lambda c, *some: F.col(c).bitwiseAND(F.lit(sum(1 << place[v] for v in some))) != 0
    d = degrees(edges).join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit("_")))
    fits = reduce(lambda x, y: x + y, (F.when(_fits(query, v, F.col("label"), F.col("degree")), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, v in enumerate(at)))
    d = d.groupBy("id", "degree").agg(F.bit_or(fits).alias("fits")).filter("fits <> 0").withColumn("key", F.col("id") * F.lit(1 << len(at)).cast("long") + F.col("fits"))
    end = lambda p: d.select(F.col("id").alias(p), F.struct("degree", "id", "key").alias(f"{p}_end"))
    ends = edges.join(end("src"), "src").join(end("dst"), "dst").select(F.least("src_end", "dst_end")["key"].alias("src"), F.greatest("src_end", "dst_end")["key"].alias("dst"))
    useful = [has("src", s.anchor) & has("dst", *s.higher)] + [has("src", x) & has("dst", y) for p in s.pairs for x, y in (p, p[::-1])]
    star = written(ends.filter(reduce(lambda x, y: x | y, useful)))
    own = f"v{s.anchor}"
    if s.pairs:
        t = written(listed(star).filter(has("u", s.anchor)))
        t = t.select(F.col("u").alias(own), F.col("v").alias("a"), F.col("w").alias("b")).unionByName(t.select(F.col("u").alias(own), F.col("w").alias("a"), F.col("v").alias("b")))
    link = lambda x, y: t.filter(has("a", x) & has("b", y)).select(own, F.col("a").alias(f"v{x}"), F.col("b").alias(f"v{y}"))
    out, placed, left = None, set(), list(s.pairs)
    while left:  # always a pair that most vertices placed before tie
        x, y = max(left, key=lambda p: len(placed & set(p)))
        left.remove((x, y))
        out = link(x, y) if out is None else out.join(link(x, y), [own, *(f"v{v}" for v in (x, y) if v in placed)])
        placed |= {x, y}
    for n in s.higher:
        if n not in placed:
            one = star.filter(has("src", s.anchor) & has("dst", n)).select(F.col("src").alias(own), F.col("dst").alias(f"v{n}"))
            out = one if out is None else out.join(one, own)
    assert out is not None
    for i, x in enumerate(s.higher):
        for y in s.higher[i + 1 :]:
            if (x, y) not in s.pairs:
                out = out.filter(F.col(f"v{x}") != F.col(f"v{y}"))
    return out.select(*(F.shiftright(f"v{v}", len(at)).alias(f"v{v}") for v in at))


def anchored_count(edges: DataFrame, labels: DataFrame, query: Query, s: Slice) -> DataFrame:
    """One row, ``matches`` of a star."""
    return slice_matches(edges, labels, query, s).agg(F.count("*").alias("matches"))


def star_index(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each vertex with later neighbours: ``id, label, degree, tc, size, max_degree, vertices, labels,
    degrees, vertex_tc, edges``. Position 0 of the lists is the vertex itself, then its later neighbours in order;
    ``vertex_tc`` counts its triangles through each, ``edges`` are the pairs that close them."""
    return stars(edges, labels)


def write_index(edges: DataFrame, labels: DataFrame, path: str) -> None:
    """The index as Parquet, sorted by label and size within files, so that their bounds prune row groups."""
    star_index(edges, labels).repartition("label").sortWithinPartitions("label", "size").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, query: Query | None = None, s: Slice | None = None) -> DataFrame:
    """The index; for a star only rows that may match it, by filters that reach the scan."""
    index = spark.read.parquet(path)
    if query is None or s is None:
        return index
    return index.filter((F.col("label") == query.labels[s.anchor]) & (F.col("degree") >= query.degree(s.anchor)) & (F.col("size") >= len(s.higher)) & (F.col("tc") >= len(s.pairs)) & (F.col("max_degree") >= max(map(query.degree, s.higher))))


def star_patterns(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, root_id, children``: each vertex with those neighbours that rank lower by degree over the frequency of
    the label, of equal ones by id."""
    n = labels.groupBy("label").agg(F.count("*").alias("frequency"))
    ranked = degrees(edges).join(labels, "id").join(n, "label").select("id", "label", (F.col("degree") / F.col("frequency")).alias("rank"))
    a = ranked.select(F.col("id").alias("src"), "label", F.col("rank").alias("r1"))
    b = ranked.select(F.col("id").alias("dst"), F.col("rank").alias("r2"))
    lower = symmetric(edges).join(a, "src").join(b, "dst").filter(before(F.col("r2"), F.col("dst"), F.col("r1"), F.col("src")))
    return lower.groupBy("label", F.col("src").alias("root_id")).agg(F.array_sort(F.collect_list("dst")).alias("children"))


def label_frequencies(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("vertices"))


def top_labels(labels: DataFrame, n: int) -> DataFrame:
    """The n most frequent labels: a top-n report."""
    rank = F.row_number().over(Window.orderBy(F.desc("vertices"), "label"))
    return label_frequencies(labels).withColumn("rank", rank).filter(F.col("rank") <= n)


__all__ = ["anchored_count", "count_embeddings", "embeddings", "read_index", "star_index", "star_patterns", "vertex_triangles", "write_index"]
