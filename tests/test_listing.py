"""Triangles by parts: equal to brute force however the edges are cut, and without a row for a wedge."""

import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from knotwork.operators import cores, incidence, linked, listing, patterns, peeling, stars, triangles, trusses
from knotwork.plans.patterns import SAMPLES
from knotwork.plans.supersteps import packed_rows, stepped
from knotwork.sources import edges as source


def graph(seed: int, n: int, m: int) -> set[tuple[int, int]]:
    """Edges around some hubs, with large and negative ids."""
    pick = random.Random(seed)
    ids = [(-1) ** i * i * 7**11 for i in range(n)]
    return {(min(a, b), max(a, b)) for a, b in ((ids[int(n * pick.random() ** 2)], ids[pick.randrange(n)]) for _ in range(m)) if a != b}


def brute(edges: set[tuple[int, int]]) -> set[tuple[int, int, int]]:
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    return {(a, b, c) for a, b in edges for c in near[a] & near.get(b, set())}


@pytest.mark.parametrize("part_edges", [20, 90, 10_000])
def test_parts_list_each_triangle_once(spark, monkeypatch, part_edges):
    monkeypatch.setattr(listing, "PART_EDGES", part_edges)
    edges = graph(3, 40, 250)
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    want = brute(edges)
    assert len(want) > 100
    by_id = [tuple(r) for r in triangles.triangles(e, by="id").collect()]
    assert len(by_id) == len(set(by_id)) and set(by_id) == want
    by_degree = [tuple(sorted(r)) for r in triangles.triangles(e).collect()]
    assert len(by_degree) == len(want) and set(by_degree) == {tuple(sorted(t)) for t in want}


def test_wedges_are_closed_in_memory(spark):
    """A bipartite graph has wedges and no triangles: no join, whose rows are wedges, is in the plan."""
    e = source.canonical(spark.createDataFrame(list(itertools.product(range(12), range(100, 112))), "src bigint, dst bigint"))
    t = triangles.triangles(e)
    assert t.count() == 0
    assert "Join" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_packed_lists():
    lists = {-5: [1, 2], 3: [-(1 << 40), 7, 1 << 62], 4: [0]}
    ids, sizes, flat = (np.array(x, np.int64) for x in (list(lists), [len(x) for x in lists.values()], sum(lists.values(), [])))
    for got, want in zip(listing.unpack_lists(listing.pack_lists(ids, sizes, flat)), (ids, sizes, flat)):
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("part_rows", [30, 200, 10_000])
def test_core_numbers_of_parts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(cores, "PART_ROWS", part_rows)
    edges = graph(5, 60, 400)
    near = {v: {x for e in edges if v in e for x in e if x != v} for e in edges for v in e}
    want, k = {}, 0
    while near:
        low = [v for v in near if len(near[v]) <= k]
        k += not low
        for v in low:
            want[v] = k
            for x in near.pop(v):
                if x in near:
                    near[x].discard(v)
    got = cores.core_numbers(source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint")))
    assert {r["id"]: r["core"] for r in got.collect()} == want and len(set(want.values())) >= 3


@pytest.mark.parametrize("part_edges", [40, 10_000])
def test_trusses_of_parts(spark, monkeypatch, part_edges):
    monkeypatch.setattr(peeling, "PART_EDGES", part_edges)
    edges = graph(3, 40, 250)
    levels, left, s = {}, set(edges), 0
    support = lambda some: Counter(p for t in brute(some) for p in itertools.combinations(t, 2))
    while left:
        n = support(left)
        if low := {e for e in left if n[e] <= s}:
            levels.update(dict.fromkeys(low, s))
            left -= low
        else:
            s += 1
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    got = {(r["src"], r["dst"]): r["level"] for r in trusses.truss_levels(e).collect()}
    assert got == {e: s for e, s in levels.items() if s} and len(set(got.values())) > 2
    four_ = {e for e, s in levels.items() if s >= 2}
    n = support(four_)
    assert {(r["src"], r["dst"]): r["support"] for r in trusses.k_truss(e, 4).collect()} == {e: n[e] for e in four_}


@pytest.mark.parametrize(("rows", "least"), [(20, 0), (90, 9), (10_000, 9)])
def test_orientation_by_parts(spark, rows, least):
    """Edges lie in parts by their earlier end; they are packed before a shuffle, and no join is needed for degrees."""
    edges = graph(7, 40, 250)
    degree = Counter(v for e in edges for v in e)
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    own, bounds = listing.oriented_parts(e, rows, least)
    got = []
    for r, (part, lo, hi) in zip(sorted(own.collect(), key=lambda r: r["lo"]), bounds):
        ids, sizes, flat = listing.unpack_lists(r["data"])
        assert (r["part"], ids[0], ids[-1]) == (part, lo, hi)
        got += zip(np.repeat(ids, sizes).tolist(), flat.tolist())
    order = lambda v: (degree[v], v)
    assert sorted(got) == sorted(tuple(sorted(x, key=order)) for x in edges if min(degree[v] for v in x) >= least)
    assert len(bounds) > 5 if rows == 20 else bounds
    assert "Join" not in triangles.triangles(e)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("part_edges", [20, 10_000])
def test_triangles_of_edges_by_parts(spark, monkeypatch, part_edges):
    """Third vertices and relisted trusses, also where a triangle's edges lie in several parts; no row is a triangle."""
    monkeypatch.setattr(listing, "PART_EDGES", part_edges)
    monkeypatch.setattr(incidence, "TOLD", 50)
    edges = graph(9, 40, 250)
    want = {}
    for t in brute(edges):
        for i in range(3):
            want.setdefault(tuple(sorted(t[:i] + t[i + 1 :])), []).append(t[i])
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    found = incidence.edge_apexes(e)
    assert sorted(map(tuple, found.collect())) == sorted((*x, len(a), sorted(a)) for x, a in want.items())
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    left = edges
    while True:
        n = Counter(x for t in brute(left) for x in itertools.combinations(sorted(t), 2))
        if left == {x for x in left if n[x] >= 3}:
            break
        left = {x for x in left if n[x] >= 3}
    assert 0 < len(left) < len(edges)
    for rounds in (0, 1):
        got = trusses.k_truss(e, 5, core_rounds=rounds, method="relist")
        assert sorted(map(tuple, got.collect())) == sorted((*x, n[x]) for x in left)
    assert trusses.k_truss(e, 40, method="relist").collect() == []


@pytest.mark.parametrize("part_edges", [60, 10_000])
def test_parts_refine_levels_and_peel_cores(spark, monkeypatch, part_edges):
    """Levels against peeling, and a truss with the full core by parts; no join, whose rows were triangles or edges."""
    monkeypatch.setattr(peeling, "PART_EDGES", part_edges)
    edges = graph(11, 40, 300) | {(a + 1, b + 1) for a, b in itertools.combinations(range(8), 2)} | {(1, -1000 - i) for i in range(9)}
    levels, left, s = {}, set(edges), 0
    while left:
        n = Counter(p for t in brute(left) for p in itertools.combinations(t, 2))
        if low := {e for e in left if n[e] <= s}:
            levels.update(dict.fromkeys(low, s))
            left -= low
        else:
            s += 1
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    found = trusses.max_truss(e)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["src"], r["dst"]): r["level"] for r in found.collect()} == {e: s for e, s in levels.items() if s} and max(levels.values()) >= 5
    some = {e for e, s in levels.items() if s >= 3}
    n = Counter(p for t in brute(some) for p in itertools.combinations(t, 2))
    got = trusses.k_truss(e, 5, core_rounds=None)
    assert sorted(map(tuple, got.collect())) == sorted((*e, n[e]) for e in some)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_triangle_of_a_packed_state_is_three_bytes():
    """Places within lists instead of places among all edges."""
    ids, sizes = np.arange(3000), np.full(3000, 30)
    flat = (np.repeat(ids, 30) + np.tile(np.arange(1, 31), 3000)).astype(np.int64)
    own = ids[:2970], sizes[:2970], flat[: 2970 * 30]
    a, b, c = (np.concatenate(x) for x in zip(*peeling.Part(*own).places(*own)))
    order = np.argsort(a, kind="stable")
    none = np.zeros(0, np.int64)
    state = lambda n: peeling.State(own, (none,) * 3, (none,) * 3, none, a[order][:n], b[order][:n], c[order][:n])
    assert len(a) > 1_000_000 and len(state(len(a)).packed()) - len(state(0).packed()) <= 3 * len(a)
    again = peeling.State.of(state(len(a)).packed())
    assert all((x == y[order]).all() for x, y in ((again.a, a), (again.b, b), (again.c, c)))


@pytest.mark.parametrize("part_edges", [60, 10_000])
def test_stars_by_parts(spark, monkeypatch, part_edges):
    """Stars against brute force, also of vertices with several labels or none; triangles are rows of no aggregation."""
    monkeypatch.setattr(listing, "PART_EDGES", part_edges)
    monkeypatch.setattr(stars, "BATCH_ENTRIES", 40)
    edges = graph(13, 30, 150)
    near = {v: {x for e in edges if v in e for x in e if x != v} for e in edges for v in e}
    of = {v: [["B"], ["A", "Über"], ["_"]][i % 3] for i, v in enumerate(sorted(near))}
    labels = spark.createDataFrame([(v, x) for v, some in of.items() for x in some if x != "_"], "id bigint, label string")
    rank = lambda v: (len(near[v]), v)
    want = []
    for u in near:
        later = sorted((v for v in near[u] if rank(v) > rank(u)), key=rank)
        closing = sorted((min(a, b), max(a, b)) for a, b in itertools.combinations(later, 2) if b in near[a])
        entries = [(v, x) for v in later for x in of[v]]
        for label in of[u] if later else []:
            c = [len(closing), *(sum(v in p for p in closing) for v, _ in entries)]
            want.append((u, label, len(near[u]), len(closing), len(entries), len(near[later[-1]]), [u, *(v for v, _ in entries)], [label, *(x for _, x in entries)], [len(near[u]), *(len(near[v]) for v, _ in entries)], c, closing))
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    found = patterns.star_index(e, labels)
    assert sorted((*r[:10], [tuple(x) for x in r[10]]) for r in found.collect()) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2  # of the edges and of degrees


@pytest.mark.parametrize("first_state", [lambda n, k: (n[:k], np.zeros(len(n), np.int64)), lambda n, k: (np.concatenate([n[:k], np.full(len(n) - k, peeling.NO_BOUND)]), np.zeros(0, np.int64), np.zeros(0, np.int64))], ids=["peel", "refine"])
def test_a_full_part_leaves_room_in_an_executor(first_state):
    """What numpy holds at most while a task lists a full part's triangles and takes a step with them."""
    n = peeling.PART_EDGES // 6
    ids, sizes = np.arange(n), np.full(n, 6)
    flat = np.repeat(ids, 6) + np.tile(np.arange(1, 7), n)
    row = packed_rows([(0, 0, 0, n - 1, listing.pack_lists(ids, sizes, flat))])
    step = peeling._refine if len(first_state(np.zeros(1), 1)) == 3 else peeling._peel(3)
    tracemalloc.start()
    try:
        (state,) = [b for b in peeling._triangles([(0, 0, n - 1)], first_state)(iter([row]))]
        (after,) = stepped(step)(iter([state]))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert len(peeling.State.of(after.column("data")[0].as_py()).own[2]) == 6 * n
    assert peak < 300


def test_parts_without_messages_rest():
    """After the first step a part that hears nothing keeps its state, unread."""
    rows = packed_rows([(0, 0, 0, 0, b"a"), (1, 0, 0, 0, b"b"), (1, 1, 0, 0, b"m"), (2, 0, 0, 0, b"c")])
    seen = []

    def step(part, state, got):
        seen.append((part, state, [m for _, m in got]))
        yield part, 0, 0, 0, b"new"

    states = lambda idle: [(r["part"], r["data"]) for b in stepped(step, idle)(iter([rows])) for r in b.to_pylist()]
    assert states(True) == [(0, b"a"), (1, b"new"), (2, b"c")] and seen == [(1, b"b", [b"m"])]
    assert states(False) == [(p, b"new") for p in range(3)]


@pytest.mark.parametrize(("part_edges", "entries"), [(40, 1), (100_000, 100), (100_000, 1 << 19)])
def test_linked_triangles_by_parts(spark, monkeypatch, part_edges, entries):
    """As many as the joins find, also where third vertices meet or lie in other parts; no path is a row."""
    monkeypatch.setattr(linked, "PART_EDGES", part_edges)
    monkeypatch.setattr(linked, "ENTRIES", entries)
    edges = graph(17, 30, 260)
    of = {v: "AABCDE"[i % 6] for i, v in enumerate(sorted({x for e in edges for x in e}))}
    labels = spark.createDataFrame(list(of.items()), "id bigint, label string")
    near = {v: {x for e in edges if v in e for x in e if x != v} for v in of}
    like = lambda label, *ends: [v for v in of if of[v] == label and all(v in near[x] for x in ends)]
    want = sum(p != a and p != q for b in like("B") for c in like("C", b) for a in like("A", c) for d in like("D", a, b) for p in like("A", b, c) for q in like("A", a, d))
    e = source.canonical(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
    q5 = SAMPLES["q5"]
    found = patterns.count_embeddings(e, labels, q5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect() == [(want,)] and want > 50
    none = patterns.count_embeddings(e, labels.filter("label <> 'D'"), q5)
    assert none.collect() == [(0,)]
