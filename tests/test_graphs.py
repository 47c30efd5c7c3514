"""Hand-made graphs, invariants between operators, formats, plans and partitions."""

import itertools

import pytest
from pyspark.sql import functions as F

from knotwork.functions.scalars import packed, sorted_three, unpacked
from knotwork.operators import clustering, cores, graph, partitioning, patterns, triangles, trusses
from knotwork.plans import patterns as plans
from knotwork.sources import edges as source
from knotwork.sources import sinks

CLIQUE = lambda n: list(itertools.combinations(range(1, n + 1), 2))
GRAPHS = {
    "k4": (CLIQUE(4), 4, {v: 3 for v in range(1, 5)}, {4}, 1.0),
    "k5": (CLIQUE(5), 10, {v: 4 for v in range(1, 6)}, {5}, 1.0),
    "pendant": ([(1, 2), (1, 3), (2, 3), (3, 4)], 1, {1: 2, 2: 2, 3: 2, 4: 1}, {3}, 7 / 12),
    "bowtie": ([(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)], 2, {v: 2 for v in range(1, 6)}, {3}, 13 / 15),
    "star": ([(1, k) for k in range(2, 7)], 0, {v: 1 for v in range(1, 7)}, set(), 0.0),
    "path": ([(1, 2), (2, 3), (3, 4)], 0, {v: 1 for v in range(1, 5)}, set(), 0.0),
    "empty": ([], 0, {}, set(), 0.0),
}


def frame(spark, edges):
    return source.canonical(spark.createDataFrame(edges, "src bigint, dst bigint"))


@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs(spark, name):
    edges, count, core, truss, lcc = GRAPHS[name]
    e = frame(spark, edges)
    assert triangles.triangle_count(e).first()[0] == count
    assert {r["id"]: r["core"] for r in cores.core_numbers(e).collect()} == core
    levels = {(r["src"], r["dst"]): r["trussness"] for r in trusses.truss_levels(e).collect()}
    assert set(levels.values()) == truss
    assert {(r["src"], r["dst"]): r["trussness"] for r in trusses.max_truss(e).collect()} == levels
    assert clustering.average_lcc(e).first()[0] == pytest.approx(lcc)
    s = clustering.graph_stats(e).first()
    assert (s["vertices"], s["edges"], s["triangles"]) == (len(core), len(edges), count)
    assert clustering.global_cc(e).first()["triangles"] == count
    assert 0 <= clustering.transitivity(e).first()["transitivity"] <= 1


def test_k_core_and_k_truss(spark):
    e = frame(spark, GRAPHS["pendant"][0] + [(a + 10, b + 10) for a, b in CLIQUE(5)])
    assert cores.k_core(e, 3).count() == 10
    assert cores.k_core(e, 3, max_iter=0).count() == e.count()
    assert trusses.k_truss(e, 5).count() == 10
    assert trusses.k_truss(e, 6).count() == 0
    assert trusses.k_truss(e, 3, method="relist").count() == trusses.k_truss(e, 3).count() == 13
    with pytest.raises(ValueError):
        trusses.k_truss(e, 2)
    assert [tuple(r) for r in cores.max_core(e, start=1, step=2).orderBy("k").collect()] == [(1, 9), (3, 5), (4, 5)]


def test_edge_text(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.txt").write_text("# c\n 1 2\n1 2 3\n3 3\n1 2\n2\t1\n1   2\n")
    raw = source.edges_from_text(spark, str(tmp_path / "g"))
    assert raw.count() == 3
    assert [tuple(r) for r in source.canonical(raw).collect()] == [(1, 2)]
    sinks.write_undirected(source.canonical(raw), str(tmp_path / "out"), one_file=True)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert sorted(map(tuple, source.edges_from_text(spark, str(tmp_path / "out")).collect())) == [(1, 2), (2, 1)]


def test_labels(spark, tmp_path):
    v = spark.range(5)
    a, b = (sorted(map(tuple, source.random_labels(v, ["A", "B"], seed=3).collect())) for _ in range(2))
    assert a == b
    sinks.write_labels(source.random_labels(v, ["A", "B"], seed=3), str(tmp_path / "l"))
    assert sorted(map(tuple, source.labels_from_text(spark, str(tmp_path / "l")).collect())) == a
    assert {r["label"] for r in source.with_labels(v).collect()} == {"_"}


def test_plans():
    first = {n: plans.slices(q)[0] for n, q in plans.SAMPLES.items()}
    assert {n: (s.anchor, s.higher) for n, s in first.items()} == {"q1": (1, (2, 3)), "q2": (2, (3, 1)), "q2_default": (2, (3, 1)), "q3": (1, (4, 2, 3)), "q4": (1, (2, 3, 4, 5)), "q5": (1, (3, 2))} | {"q5": (first["q5"].anchor, first["q5"].higher)}
    for q in plans.SAMPLES.values():
        covered = {(min(a, b), max(a, b)) for s in plans.slices(q) for a, b in [*((s.anchor, h) for h in s.higher), *s.pairs]}
        assert covered == set(q.edges)
    assert plans.read_query("#neighbors\n1 2 3\n2 3\n4 1\n#labels\n1 A\n2 B\n3 C\n4 A\n") == plans.SAMPLES["q2"]


def test_patterns_and_index(spark, tmp_path):
    e = frame(spark, CLIQUE(5))
    labels = spark.createDataFrame(list(zip(range(1, 6), "ABCDE")), "id bigint, label string")
    count = lambda q, l=labels: patterns.count_embeddings(e, l, q).first()[0]
    assert count(plans.SAMPLES["q1"]) == count(plans.SAMPLES["q4"]) == 1
    assert count(plans.SAMPLES["q3"]) == 0
    same = labels.withColumn("label", F.lit("A"))
    assert count(plans.SAMPLES["q3"], same) == 120
    patterns.write_index(e, labels, str(tmp_path / "i"))
    q = plans.SAMPLES["q4"]
    hit = patterns.read_index(spark, str(tmp_path / "i"), q, plans.slices(q)[0])
    assert [r["id"] for r in hit.collect()] == [1]
    assert "PushedFilters" in hit._jdf.queryExecution().toString()
    assert patterns.read_index(spark, str(tmp_path / "i")).count() == 4


def test_invariants(spark):
    e = source.co_occurrence(spark, "/root/testdata/sf0.001").cache()
    t = triangles.triangles(e).cache()
    assert triangles.vertex_triangles(t).agg(F.sum("triangles")).first()[0] == 3 * t.count() == triangles.edge_support(t).agg(F.sum("support")).first()[0] == 678
    assert graph.degrees(e).agg(F.sum("degree")).first()[0] == 2 * e.count() == 2 * 589
    assert trusses.k_truss(e, 4).join(cores.k_core(e, 3), ["src", "dst"], "left_anti").count() == 0
    assert trusses.k_truss(e, 4, core_rounds=0).count() == trusses.k_truss(e, 4, core_rounds=None).count() == 154


def test_partitions(spark):
    e = source.co_occurrence(spark, "/root/testdata/sf0.001").cache()
    for parts in (partitioning.power_partitions(e, 4), partitioning.hierarchical_partitions(e, 4)):
        rows = parts.collect()
        assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in graph.vertices(e).collect())
        assert {r["pid"] for r in rows} <= set(range(4))
        own = {r["id"]: r["pid"] for r in rows}
        cut = sum(own[r["src"]] != own[r["dst"]] for r in e.collect())
        assert tuple(partitioning.cut_cost(e, parts).first()) == (cut, cut // 2)
    assert sorted(map(tuple, partitioning.power_partitions(e, 4).collect())) == sorted(map(tuple, partitioning.power_partitions(e, 4).collect()))
    merged = partitioning.merge_small(partitioning.hash_partitions(e, 8), 100)
    assert partitioning.balance(merged).first()["largest"] <= 100


def test_power_partitions_spread_over_twenty_hops_and_to_further_components(spark):
    """Two cliques, each with a chain of 26; then cliques and a star that the first seeds can't reach."""
    side = lambda o: [(o + a, o + b) for a in range(4) for b in range(a)] + [(o, o + 4)] + [(o + i, o + i + 1) for i in range(4, 29)]
    frame = lambda edges: spark.createDataFrame([(min(e), max(e)) for e in edges], "src bigint, dst bigint").localCheckpoint()
    e = frame(side(0) + side(100))
    seed = next(s for s in range(20) if len({r["pid"] for r in partitioning.seeds(e, 2, 0, s).collect()}) == 2)
    own = {r["id"]: r["pid"] for r in partitioning.power_partitions(e, 2, 0, seed).collect()}
    assert len(own) == 60
    assert len({own[i] for i in range(29)}) == len({own[100 + i] for i in range(29)}) == 1 and own[0] != own[100]
    clique = lambda o, n: [(o + a, o + b) for a in range(n) for b in range(a)]
    parts = partitioning.power_partitions(frame(clique(0, 8) + [(50, i) for i in range(51, 55)] + [(i, i + 10) for i in range(51, 55)]), 1, 0)
    assert len({r["id"] for r in parts.collect()}) == 17


def test_scalars(spark):
    r = spark.createDataFrame([(7, 3, 5)], "a bigint, b bigint, c bigint").select(packed(F.col("a"), F.col("b")).alias("p"), sorted_three(*map(F.col, "abc")).alias("s")).select("*", unpacked(F.col("p")).alias("u")).first()
    assert (r["p"], r["s"], tuple(r["u"])) == ((3 << 32) | 7, [3, 5, 7], (3, 7))


def test_a_star_s_matches_are_rows_once(spark):
    """Against brute force, with repeated labels, several labels of a vertex, ids below 0 and vertices without a label."""
    from itertools import combinations, permutations
    from random import Random

    from knotwork.operators import patterns
    from knotwork.plans.patterns import SAMPLES, slices

    r = Random(3)
    e = sorted({p for p in combinations(range(-4, 12), 2) if r.random() < 0.6})
    labels = [(i, "ABCDE"[i % 5]) for i in range(-4, 11)] + [(2, "C"), (3, "A"), (5, "A")]
    of = {i: {x for v, x in labels if v == i} or {"_"} for i in range(-4, 12)}
    near = {i: {b if a == i else a for a, b in e if i in (a, b)} for i in of}
    after = {(a, b) for a in of for b in near[a] if (len(near[a]), a) < (len(near[b]), b)}
    for name in ("q2", "q3", "q5"):
        q = SAMPLES[name]
        s = slices(q)[0]
        at = (s.anchor, *s.higher)
        fits = lambda m, q=q: all(q.labels[v] in of[x] and len(near[x]) >= q.degree(v) for v, x in m.items())
        want = [m for x in permutations(of, len(at)) if fits(m := dict(zip(at, x))) and all((x[0], y) in after for y in x[1:]) and all(m[b] in near[m[a]] for a, b in s.pairs)]
        got = patterns.slice_matches(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(labels, "id long, label string"), q, s)
        assert sorted(map(tuple, got.select(*(f"v{v}" for v in at)).collect())) == sorted(tuple(m[v] for v in at) for m in want)


def test_a_loose_vertex_and_triangles_of_one_label_make_no_wedges(spark):
    """Counts against brute force; the embeddings of a vertex of one edge, and a triangle's wedges, are no rows."""
    from itertools import combinations, permutations
    from random import Random

    from knotwork.plans.patterns import SAMPLES, _sample

    r = Random(5)
    e = sorted({p for p in combinations(range(-4, 9), 2) if r.random() < 0.5} | {(-1, x) for x in range(20, 30)})
    f = spark.createDataFrame(e, "src long, dst long")
    ids = {i for x in e for i in x}
    for q, of in ((SAMPLES["q2_default"], {}), (SAMPLES["q2"], {i: "ABC"[i % 3] for i in ids}), (_sample("1-2 1-3 2-3 3-4", "AABA"), {i: "AB"[i % 2] for i in ids})):
        fits = lambda m, q=q, of=of: all(q.labels[v] == of.get(x, "_") for v, x in m.items())
        linked = set(e) | {x[::-1] for x in e}
        want = sum(1 for x in permutations(sorted(ids), 3) if (x[0], x[1]) in linked and (x[0], x[2]) in linked and (x[1], x[2]) in linked for y in ids - set(x) if fits(m := dict(zip((1, 2, 3, 4), (*x, y)))) and all((m[a], m[b]) in linked for a, b in q.edges))
        labels = spark.createDataFrame(list(of.items()), "id long, label string")
        got = patterns.count_embeddings(f, labels, q)
        assert got.first()[0] == want > 0
        if not of:
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert patterns.count_embeddings(f.limit(0), labels, SAMPLES["q2_default"]).first()[0] == 0
