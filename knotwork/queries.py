"""The registered queries of the graph operators, each with its SQL for DuckDB.

The graph is that of parts ordered together, of all rows of lineitem; labels are A to E by part number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clustering, cores, graph, incidence, partitioning, patterns, triangles, trusses
from .plans.fixpoint import written
from .plans.patterns import SAMPLES, Query, slices
from .sources import edges as source
from .sources import sinks

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions: edges, both directions, degrees, oriented edges and triangles.
BASE = """
li AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS v FROM lineitem),
e AS (SELECT DISTINCT a.v AS src, b.v AS dst FROM li a JOIN li b USING (g) WHERE a.v < b.v),
s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
d AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY 1),
o AS (SELECT s.src, s.dst, a.degree AS src_deg, b.degree AS dst_deg FROM s JOIN d a ON a.id = s.src JOIN d b ON b.id = s.dst
      WHERE a.degree < b.degree OR (a.degree = b.degree AND s.src < s.dst)),
t AS (SELECT a.src AS u, a.dst AS v, b.dst AS w FROM o a JOIN o b ON a.src = b.src JOIN o c ON c.src = a.dst AND c.dst = b.dst),
te AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, w AS apex FROM t UNION ALL SELECT least(u, w), greatest(u, w), v FROM t
       UNION ALL SELECT least(v, w), greatest(v, w), u FROM t),
vt AS (SELECT id, count(*) AS triangles FROM (SELECT u AS id FROM t UNION ALL SELECT v FROM t UNION ALL SELECT w FROM t) GROUP BY 1),
lcc AS (SELECT d.id, degree, coalesce(triangles, 0) AS triangles,
        CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(triangles, 0) / (degree::DOUBLE * (degree - 1)) END::DOUBLE AS lcc
        FROM d LEFT JOIN vt ON vt.id = d.id),
lab AS (SELECT id, degree, substr('ABCDE', 1 + id % 5, 1) AS label FROM d)
"""
ROUNDS = 60


def _sql(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE.strip()}{', ' + more if more else ''} {select}"


def query(name: str, select: str | None = None, more: str = "", recursive: bool = False):
    """Registers a query and, unless nothing in SQL says it, its SQL."""

    def register(run: Run) -> Run:
        QUERIES[name] = run
        if select:
            ORACLES[name] = _sql(select, more, recursive)
        return run

    return register


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.co_occurrence(spark, sf_dir, None)


def _labels(e: DataFrame) -> DataFrame:
    return graph.vertices(e).select("id", source.derived_label(F.col("id")).alias("label"))


def _on_edges(name: str, f: Callable[[DataFrame], DataFrame], select: str | None, more: str = "", recursive: bool = False) -> None:
    """A query of the edges alone, which are written once, as most operators read them several times."""
    query(name, select, more, recursive)(lambda spark, sf_dir: f(written(_edges(spark, sf_dir))))


def _joined(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


_on_edges("edges", lambda e: e, "SELECT src, dst FROM e")
_on_edges("edges_symmetric", source.symmetric, "SELECT src, dst FROM s")
_on_edges("degrees", graph.degrees, "SELECT id, degree FROM d")
_on_edges("degree_histogram", clustering.degree_histogram, "SELECT degree, count(*) AS vertices FROM d GROUP BY 1")
_on_edges("neighbor_list", lambda e: graph.neighbor_list(e).select("id", _joined("neighbors")), "SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM s GROUP BY 1")
_on_edges("oriented_edges", graph.orient, "SELECT src, dst, src_deg, dst_deg FROM o")
_on_edges(
    "higher_neighbors",
    lambda e: graph.higher_neighbors(e).select("id", "degree", _joined("higher")),
    "SELECT id, degree, coalesce(h, '') AS higher FROM d LEFT JOIN (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst_deg, dst) AS h FROM o GROUP BY 1) x ON x.src = d.id",
)
_on_edges("wedges", lambda e: triangles.wedges(graph.orient(e)).groupBy("u").agg(F.count("*").alias("wedges")), "SELECT src AS u, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS wedges FROM o GROUP BY 1 HAVING count(*) > 1")
_on_edges("triangles", triangles.triangles, "SELECT u, v, w FROM t")
_on_edges("triangles_by_id", lambda e: triangles.triangles(e, by="id"), "SELECT a.src AS u, a.dst AS v, b.dst AS w FROM e a JOIN e b ON a.src = b.src JOIN e c ON c.src = a.dst AND c.dst = b.dst")
_on_edges("triangle_count", triangles.triangle_count, "SELECT count(*) AS triangles FROM t")
_on_edges("vertex_triangles", lambda e: triangles.vertex_triangles(triangles.triangles(e)), "SELECT id, triangles FROM vt")
_on_edges("edge_support", lambda e: triangles.edge_support(triangles.triangles(e)), "SELECT src, dst, count(*) AS support FROM te GROUP BY 1, 2")
_on_edges(
    "apex_sets",
    lambda e: incidence.edge_apexes(e).select("src", "dst", "support", _joined("apexes")),
    "SELECT src, dst, count(*) AS support, string_agg(apex::VARCHAR, ',' ORDER BY apex) AS apexes FROM te GROUP BY 1, 2",
)
_on_edges("local_cc", clustering.local_cc, "SELECT id, degree, triangles, lcc FROM lcc")
_on_edges("average_lcc", clustering.average_lcc, "SELECT round(coalesce(avg(lcc), 0), 9) AS avg_lcc FROM lcc")
_on_edges(
    "global_cc",
    clustering.global_cc,
    "SELECT n AS vertices, c AS triangles, CASE WHEN n < 2 THEN 0.0 ELSE c / (n::DOUBLE * (n - 1)) END::DOUBLE AS global_cc FROM (SELECT count(*) AS n FROM d), (SELECT count(*) AS c FROM t)",
)
_on_edges(
    "transitivity",
    clustering.transitivity,
    "SELECT n AS wedges, c AS triangles, CASE WHEN n = 0 THEN 0.0 ELSE 3.0 * c / n::DOUBLE END::DOUBLE AS transitivity FROM (SELECT CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS n FROM d), (SELECT count(*) AS c FROM t)",
)
_on_edges(
    "graph_stats",
    clustering.graph_stats,
    """SELECT n AS vertices, m AS edges, round(m / n::DOUBLE, 9) AS edges_per_vertex, round(2.0 * m / n::DOUBLE, 9) AS avg_deg, CAST(2 * m // n AS BIGINT) AS avg_deg_floor, x AS max_deg, c AS triangles, l AS avg_lcc
       FROM (SELECT count(*) AS n, max(degree) AS x FROM d), (SELECT count(*) AS m FROM e), (SELECT count(*) AS c FROM t), (SELECT round(avg(lcc), 9) AS l FROM lcc)""",
)

#: Core numbers: each vertex takes the h-index of its neighbours' values, from degrees downwards.
_CORE = f"""h AS (SELECT 0 AS i, id, degree AS core FROM d UNION ALL
  SELECT i + 1, id, max(least(core, rk)) FROM (SELECT h.i, s.src AS id, h.core, row_number() OVER (PARTITION BY s.src ORDER BY h.core DESC) AS rk FROM h JOIN s ON s.dst = h.id)
  WHERE i < {ROUNDS} GROUP BY i, id),
core AS MATERIALIZED (SELECT id, core FROM h WHERE i = {ROUNDS})"""
_IN_CORE = "SELECT src, dst FROM e JOIN core a ON a.id = src JOIN core b ON b.id = dst WHERE a.core >= {k} AND b.core >= {k}"
#: Two rounds of peeling.
_PEEL = """r AS (SELECT 0 AS i, src, dst FROM s UNION ALL
  SELECT i + 1, src, dst FROM (SELECT i, src, dst, count(*) OVER (PARTITION BY src) AS ds, count(*) OVER (PARTITION BY dst) AS dd FROM r)
  WHERE ds >= {k} AND dd >= {k} AND i < 2)"""
for _k in (3, 4, 5, 75, 90):
    _on_edges(f"k_core_{_k}", lambda e, k=_k: cores.k_core(e, k), _IN_CORE.format(k=_k), _CORE, True)
for _k in (4, 90):
    _on_edges(f"k_core_{_k}_two_rounds", lambda e, k=_k: cores.k_core(e, k, max_iter=2), "SELECT DISTINCT src, dst FROM r WHERE i = 2 AND src < dst", _PEEL.format(k=_k), True)
_on_edges("core_numbers", cores.core_numbers, "SELECT id, core FROM core", _CORE, True)
_on_edges("core_histogram", lambda e: cores.core_numbers(e).groupBy("core").agg(F.count("*").alias("vertices")), "SELECT core, count(*) AS vertices FROM core GROUP BY 1", _CORE, True)
_on_edges(
    "max_core",
    lambda e: cores.max_core(e, start=1, step=1).select("k", "vertices").distinct(),
    "SELECT k::INTEGER AS k, count(*) AS vertices FROM range(1, (SELECT max(core) + 1 FROM core)) x(k) JOIN core ON core >= k GROUP BY 1",
    _CORE,
    True,
)
#: Truss levels: each edge takes the h-index, over its triangles, of the lesser value of the other two edges.
_LEVEL = f"""te3 AS MATERIALIZED (SELECT src, dst, least(src, apex) AS a, greatest(src, apex) AS b, least(dst, apex) AS x, greatest(dst, apex) AS y FROM te),
z AS (SELECT 0 AS i, src, dst, count(*) AS level FROM te GROUP BY src, dst UNION ALL
  SELECT i + 1, src, dst, max(least(level, rk)) FROM (SELECT i, src, dst, level, row_number() OVER (PARTITION BY src, dst ORDER BY level DESC) AS rk FROM (
    SELECT p.i, te3.src, te3.dst, least(p.level, o.level) AS level FROM te3 JOIN z p ON p.src = te3.a AND p.dst = te3.b JOIN z o ON o.src = te3.x AND o.dst = te3.y)) WHERE i < {ROUNDS} GROUP BY i, src, dst),
lv AS MATERIALIZED (SELECT src, dst, level FROM z WHERE i = {ROUNDS})"""
_LEVELS = "SELECT src, dst, level, level + 2 AS trussness FROM lv"
_TRUSS = """SELECT te3.src, te3.dst, count(*) AS support FROM te3 JOIN lv l ON l.src = te3.src AND l.dst = te3.dst JOIN lv p ON p.src = te3.a AND p.dst = te3.b JOIN lv o ON o.src = te3.x AND o.dst = te3.y
WHERE l.level >= {s} AND p.level >= {s} AND o.level >= {s} GROUP BY 1, 2"""
for _k in (3, 4, 5, 8):
    _on_edges(f"k_truss_{_k}", lambda e, k=_k: trusses.k_truss(e, k), _TRUSS.format(s=_k - 2), _LEVEL, True)
_on_edges("k_truss_4_relist", lambda e: trusses.k_truss(e, 4, method="relist"), _TRUSS.format(s=2), _LEVEL, True)
_on_edges("k_truss_4_full_core", lambda e: trusses.k_truss(e, 4, core_rounds=None), _TRUSS.format(s=2), _LEVEL, True)
_on_edges("truss_levels", trusses.truss_levels, _LEVELS, _LEVEL, True)
_on_edges("max_truss", trusses.max_truss, _LEVELS, _LEVEL, True)
_on_edges("truss_histogram", lambda e: trusses.truss_histogram(trusses.max_truss(e)), f"SELECT level, count(*) AS edges FROM ({_LEVELS}) GROUP BY 1", _LEVEL, True)


def _pattern_sql(q: Query, default: bool) -> tuple[str, str]:
    """Select and tables: one materialised table for each further vertex of the pattern, as joins of all at once are
    planned badly."""
    label = lambda v, t: "" if default else f" AND {t}.label = '{q.labels[v]}'"
    first, *rest = q.order()
    more, placed = [f"m0 AS MATERIALIZED (SELECT id AS v{first} FROM lab WHERE true{label(first, 'lab')})"], [first]
    for i, v in enumerate(rest):
        first, *others = [u for u in placed if q.joined(u, v)]
        apart = " AND ".join(f"m.v{u} <> s.dst" for u in placed)
        last = f"m{i + 1}" if not others else f"m{i + 1}_{others[0]}"
        more.append(f"{last} AS MATERIALIZED (SELECT m.*, s.dst AS v{v} FROM m{i} m JOIN s ON s.src = m.v{first} JOIN lab ON lab.id = s.dst{label(v, 'lab')} WHERE {apart})")
        for u, then in zip(others, [*(f"m{i + 1}_{x}" for x in others[1:]), f"m{i + 1}"]):
            more.append(f"{then} AS MATERIALIZED (SELECT m.* FROM {last} m JOIN s ON s.src = m.v{u} AND s.dst = m.v{v})")
            last = then
        placed.append(v)
    return f"SELECT count(*) AS embeddings FROM m{len(rest)}", ", ".join(more)


def _anchored_sql(q: Query) -> str:
    s = slices(q)[0]
    sql = f"SELECT count(*) AS matches FROM lab a{s.anchor} LEFT JOIN (SELECT u, count(*) AS tc FROM t GROUP BY 1) x ON x.u = a{s.anchor}.id"
    where = [f"a{s.anchor}.label = '{q.labels[s.anchor]}' AND a{s.anchor}.degree >= {q.degree(s.anchor)} AND coalesce(tc, 0) >= {len(s.pairs)}"]
    for n in s.higher:
        sql += f" JOIN o o{n} ON o{n}.src = a{s.anchor}.id JOIN lab a{n} ON a{n}.id = o{n}.dst AND a{n}.label = '{q.labels[n]}' AND a{n}.degree >= {q.degree(n)}"
    for x, y in s.pairs:
        sql += f" JOIN s p{x}_{y} ON p{x}_{y}.src = a{x}.id AND p{x}_{y}.dst = a{y}.id"
    where += [f"a{x}.id <> a{y}.id" for i, x in enumerate(s.higher) for y in s.higher[i + 1 :]]
    return f"{sql} WHERE {' AND '.join(where)}"


for _name, _q in SAMPLES.items():
    _default = set(_q.labels.values()) == {"_"}
    _with = (lambda e: source.with_labels(graph.vertices(e))) if _default else _labels
    _on_edges(f"pattern_{_name}", lambda e, q=_q, w=_with: patterns.count_embeddings(e, w(e), q), *_pattern_sql(_q, _default))
    if not _default:
        _on_edges(f"pattern_{_name}_anchored", lambda e, q=_q: patterns.anchored_count(e, _labels(e), q, slices(q)[0]), _anchored_sql(_q))
_on_edges(
    "star_index",
    lambda e: patterns.star_index(e, _labels(e)).select("id", "label", "degree", "tc", "size", "max_degree", _joined("vertices"), _joined("labels"), _joined("degrees"), _joined("vertex_tc"), F.array_join(F.transform("edges", lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ",").alias("edges")),
    """SELECT id, label, degree, coalesce(tc, 0) AS tc, size::INTEGER AS size, max_degree, concat(id, ',', h) AS vertices, concat(label, ',', hl) AS labels, concat(degree, ',', hd) AS degrees, concat(coalesce(tc, 0), ',', ht) AS vertex_tc, coalesce(edges, '') AS edges
       FROM lab JOIN (SELECT o.src, count(*) AS size, max(dst_deg) AS max_degree, string_agg(o.dst::VARCHAR, ',' ORDER BY dst_deg, o.dst) AS h, string_agg(b.label, ',' ORDER BY dst_deg, o.dst) AS hl,
                      string_agg(dst_deg::VARCHAR, ',' ORDER BY dst_deg, o.dst) AS hd, string_agg(coalesce(c, 0)::VARCHAR, ',' ORDER BY dst_deg, o.dst) AS ht
                      FROM o JOIN lab b ON b.id = o.dst LEFT JOIN (SELECT u, n, count(*) AS c FROM (SELECT u, v AS n FROM t UNION ALL SELECT u, w FROM t) GROUP BY 1, 2) y ON y.u = o.src AND y.n = o.dst GROUP BY 1) x ON x.src = lab.id
       LEFT JOIN (SELECT u, count(*) AS tc, string_agg(concat(least(v, w), '-', greatest(v, w)), ',' ORDER BY least(v, w), greatest(v, w)) AS edges FROM t GROUP BY 1) z ON z.u = lab.id""",
)
_on_edges(
    "star_patterns",
    lambda e: patterns.star_patterns(e, _labels(e)).select("label", "root_id", _joined("children")),
    """SELECT a.label, a.id AS root_id, string_agg(b.id::VARCHAR, ',' ORDER BY b.id) AS children FROM s
       JOIN rk a ON a.id = s.src JOIN rk b ON b.id = s.dst WHERE b.r < a.r OR (b.r = a.r AND b.id < a.id) GROUP BY 1, 2""",
    "rk AS (SELECT id, lab.label, degree / n::DOUBLE AS r FROM lab JOIN (SELECT label, count(*) AS n FROM lab GROUP BY 1) f ON f.label = lab.label)",
)
_on_edges("label_frequencies", lambda e: patterns.label_frequencies(_labels(e)), "SELECT label, count(*) AS vertices FROM lab GROUP BY 1")
_on_edges(
    "hash_partition_cut",
    lambda e: partitioning.cut_cost(e, partitioning.hash_partitions(e, 8)),
    "SELECT count(*) AS cut, CAST(count(*) // 2 AS BIGINT) AS half_cut FROM e WHERE src % 8 <> dst % 8",
)
_on_edges(
    "hash_partition_balance",
    lambda e: partitioning.balance(partitioning.hash_partitions(e, 8)),
    "SELECT count(*) AS parts, CAST(sum(n) AS BIGINT) AS vertices, max(n) AS largest, round(avg(abs(n - (SELECT count(*) FROM d) / (SELECT count(DISTINCT id % 8) FROM d)::DOUBLE)), 6) AS deviation FROM (SELECT id % 8 AS p, count(*) AS n FROM d GROUP BY 1)",
)
_on_edges("part_links", lambda e: partitioning.part_links(e, partitioning.hash_partitions(e, 8)), "SELECT CAST(least(src % 8, dst % 8) AS INTEGER) AS p1, CAST(greatest(src % 8, dst % 8) AS INTEGER) AS p2, count(*) AS edges FROM e WHERE src % 8 <> dst % 8 GROUP BY 1, 2")
_on_edges("power_partitions", lambda e: partitioning.power_partitions(e, 8), None)
_on_edges("hierarchical_partitions", lambda e: partitioning.hierarchical_partitions(e, 8), None)
_on_edges("merged_partitions", lambda e: partitioning.merge_small(partitioning.hash_partitions(e, 16), 400), None)
_on_edges(
    "numbered_edges",
    sinks.numbered,
    "SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM e",
)
_on_edges(
    "vertex_edge_ids",
    lambda e: sinks.vertex_edge_ids(e).select("id", _joined("edge_ids")),
    "SELECT id, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS edge_ids FROM (SELECT src AS id, edge_id FROM ne UNION ALL SELECT dst, edge_id FROM ne) GROUP BY 1",
    "ne AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM e)",
)


@query("part_labels", "SELECT p_partkey AS id, substr('ABCDE', 1 + p_partkey % 5, 1) AS label FROM part")
def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.part_labels(spark, sf_dir)


@query("edges_text_round_trip", "SELECT src, dst FROM e")
def edges_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions as text, read back with the rules of edge lists, each edge once again."""
    import uuid

    from .plans.fixpoint import shared_dir

    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    sinks.write_undirected(_edges(spark, sf_dir), path)
    return source.canonical(source.edges_from_text(spark, path))

