"""The Jaccard join, components and fingerprints against brute force."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import fingerprints, jaccard_join, shingles
from knotwork.llm.components import components

from .helpers import prose, rows, table, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets, root = [shingle_set(t) for _, t in docs], list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def test_edge_cases(spark):
    assert rows(jaccard_join.jaccard_components(table(spark, texts())), "doc_id", "n_shingles", "component_id") == brute(texts())
    assert jaccard_join.jaccard_components(table(spark, [])).collect() == []


def test_groups_of_near_copies(spark):
    """Chains and stars of edited copies near the threshold, with passages that unrelated documents share."""
    rng, docs = np.random.default_rng(1), []
    shared = prose(99, 60)
    for g in range(4):
        base = prose(g, 60 + 40 * g).split()
        for _ in range(25):
            w = list(base)
            for p in rng.integers(0, len(w), rng.integers(0, 5)):
                w[p] = f"edit{rng.integers(1e6)}"
            docs.append((len(docs), " ".join(w)))
            if rng.random() < 0.5:
                base = w  # a chain
    docs += [(1000 + i, f"{prose(500 + i, 30)} {shared} {prose(700 + i, 30)}") for i in range(30)]
    got = rows(jaccard_join.jaccard_components(table(spark, docs)), "doc_id", "n_shingles", "component_id")
    assert got == brute(docs)
    kept = jaccard_join.one_of_each(table(spark, docs))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {c for _, _, c in got}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 120), st.integers(0, 120), st.integers(0, 2**31))
def test_linked_sets_share_a_key(common, a, b, seed):
    """The pigeonhole: whatever the frequent shingles, linked sets meet on a level that both have."""
    r = np.random.default_rng(seed)
    x = r.integers(0, 2**63, common + a + b).astype(np.uint64)
    s, t = np.unique(x[: common + a]), np.unique(np.concatenate([x[:common], x[common + a :]]))
    if not jaccard_join.similar(common, len(s), len(t)):
        return
    frequent = r.integers(0, 256, jaccard_join.WIDTH // 8).astype(np.uint8)
    keys = [{(lv, k) for lv in jaccard_join.levels(len(z)) for k in jaccard_join.cells(z, frequent, lv).tolist()} for z in (s, t)]
    assert keys[0] & keys[1]
    p, q = (np.frombuffer(jaccard_join.bit_sketch(z), np.uint8)[None] for z in (s, t))
    w = min(p.shape[1], q.shape[1])
    assert 7 * int(np.bitwise_count(jaccard_join.folded(p, w) ^ jaccard_join.folded(q, w)).sum()) <= len(s) + len(t)


def test_shingles_don_t_depend_on_blocks(monkeypatch):
    docs = [prose(5, 4000), "", "a b", "Ä Ö  Ü\x0b\x0cß"]
    whole = shingles.shingle_sets(docs)
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(docs)))
    assert [len(s) for s in whole] == [len(shingle_set(t)) for t in docs]


def test_components(spark):
    links = [(i, i + 1) for i in range(40, 70)] + [(5, 3), (3, 5), (7, 7), (9, 2), (2, 5)]
    got = dict(rows(components(spark.createDataFrame(links, "a bigint, b bigint")), "id", "root"))
    assert got == {**{i: 40 for i in range(40, 71)}, 5: 2, 3: 2, 9: 2, 2: 2}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def edited(docs):
    """The rows in order, with the text each is edited to."""
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (d, t), (_, n) in zip(docs, [*docs[1:], *docs[:1]]):
        q = len(t) // 4
        out.append((d, t, n, t[: len(t) - q] + n[:q]))
    return out


def test_fingerprints(spark):
    docs = [*texts(), (20, "Café  AU lait"), (21, "café au\tLAIT "), (22, "각"), (23, "각"), (24, "ậ"), (25, "ậ")]
    got = fingerprints.fingerprints(table(spark, docs)).collect()
    want = edited(docs)
    canon = fingerprints.expected
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(t) == canon(e)), float(canon(t) == canon(n))) for d, t, n, e in want if d is not None
    )
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    for a, ta in docs:
        for b, tb in docs:
            if None not in (a, b):
                assert (by[a] == by[b]) == (canon(ta or "") == canon(tb or ""))
    assert fingerprints.fingerprints(table(spark, [])).collect() == []
    one = fingerprints.fingerprints(table(spark, [(1, "abcdefgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_equal_hashes_of_other_bytes_get_other_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda text: fingerprints.F.substring(text, 1, 1))
    got = dict(rows(fingerprints.fingerprints(table(spark, [(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")])), "doc_id", "fingerprint"))
    assert got[1] == got[3] != got[2]
    assert len({got[1], got[2], got[4]}) == 3


@pytest.mark.parametrize("text", ["", "plain", "é", "é", "q̣̇", "Å", "क़ ́x", "각ᆨ"])
def test_normalisation(spark, text):
    import unicodedata

    r = spark.createDataFrame([(text,)], "t string").select(fingerprints.nfc(fingerprints.F.col("t")).alias("n")).first()
    assert r["n"] == unicodedata.normalize("NFC", text)


def test_frequent_keys_go_past_the_reducer(monkeypatch):
    """One key of 5,000 sets from ten flushes, with plain keys beside it: the pairs are those of a plain grouping."""
    n, width = 500, 8
    monkeypatch.setattr(jaccard_join, "cells", lambda s, frequent, level: s[:2])
    monkeypatch.setattr(jaccard_join, "levels", lambda k: [0])
    names = iter(range(1, 10**6))
    monkeypatch.setattr(jaccard_join, "signature", lambda s, clashes=frozenset(): int(s[2]))
    sets = [[(None, np.array([7 << 33, (1000 + i // 2) << 33, next(names)], np.uint64)) for i in range(n)] for _ in range(10)]
    rows_ = []
    for some in sets:
        monkeypatch.setattr(jaccard_join, "_sets", lambda batches, some=some: iter(some))
        frequent = type("B", (), {"value": b""})()
        rows_ += [r for b in jaccard_join._keys(frequent, width, frozenset())(iter(())) for r in b.to_pylist()]
    pairs, lists = set(), {}
    kinds = jaccard_join.pa.schema([("bucket", "int32"), ("keys", "binary"), ("sigs", "binary"), ("hot", "binary"), ("key", "int64")]).append(jaccard_join.pa.field("members", jaccard_join.pa.list_(jaccard_join.pa.int64())))
    hot = []
    for bucket in {r["bucket"] for r in rows_}:
        t = jaccard_join.pa.Table.from_pylist([r for r in rows_ if r["bucket"] == bucket], kinds)
        for r in jaccard_join._groups(t).to_pylist():
            if r["members"] is not None:
                lists[r["a"], r["key"]] = r["members"]
            elif r["key"] is not None:
                hot.append((r["a"], r["b"], r["key"]))
            else:
                pairs.add((r["a"], r["b"]))
    pairs |= {(a, m) for a, b, k in hot for m in lists[b, k] if m != a}
    want, by = set(), {}
    for some in sets:
        for _, s in some:
            for k in s[:2].tolist():
                by.setdefault(k, []).append(int(s[2]))
    for members in by.values():
        want |= {(min(members), m) for m in members if m != min(members)}
    assert pairs == want
    frequent_key = sum(np.count_nonzero(np.frombuffer(r["keys"], np.uint32) == 14) for r in rows_ if r["keys"])
    assert frequent_key == len(sets)


def test_a_pair_of_many_buckets_is_one_row():
    """Three near copies with 400 keys in 40 buckets: a bucket gives a row for each part, all of them give each pair once."""
    pa, rows_ = jaccard_join.pa, []
    for bucket in range(40):
        keys = np.repeat(np.arange(10, dtype=np.uint32), 3)
        t = {"bucket": [bucket], "keys": [keys.tobytes()], "sigs": [np.tile(np.array([-5, 7, 9]), 10).tobytes()], "hot": [np.zeros(0, np.int32).tobytes()], "key": [None], "members": [None]}
        kinds = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sigs", pa.binary()), ("hot", pa.binary()), ("key", pa.int64()), ("members", pa.list_(pa.int64()))])
        rows_ += jaccard_join._packed_groups(3)(pa.Table.from_pydict(t, kinds)).to_pylist()
    assert len(rows_) <= 40 * 2 and all(r["b"] is None for r in rows_)
    got = []
    for part in {r["part"] for r in rows_}:
        got += [(r["a"], r["b"]) for r in jaccard_join._pairs(pa.table({"pairs": [r["pairs"] for r in rows_ if r["part"] == part]})).to_pylist()]
    assert sorted(got) == [(-5, 7), (-5, 9)]


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    """Many documents under one passage, a few of them near copies, give in blocks what brute force gives."""
    passage = prose(4, 12)
    docs = [(i, f"{passage} {prose(10_000 + i, 6)}") for i in range(300)]
    docs += [(1000 + i, f"{passage} {prose(10_000 + i, 6)} tail") for i in range(0, 300, 9)]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", (20, 40))
    monkeypatch.setattr(jaccard_join, "LOCAL", 4)
    assert rows(jaccard_join.jaccard_components(table(spark, docs)), "doc_id", "n_shingles", "component_id") == brute(docs)


def test_sets_that_share_a_signature_get_the_other():
    s = np.array([3, 5], np.uint64)
    own = shingles.signature(s)
    assert shingles.signature(s, frozenset({own})) == shingles.other_signature(s) != own
    assert shingles.signature(s, frozenset({own + 1})) == own


def test_one_of_each_acts_on_rows(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    docs = [(1, a), (2, a), (2, b), (2, c), (3, b), (4, None), (4, ""), (5, c), (5, c), (None, a), (None, prose(9, 40)), (None, prose(9, 40)), (6, prose(8, 40))]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(table(spark, docs)).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (2, c), (4, None), (4, ""), (None, prose(9, 40)), (6, prose(8, 40))], key=repr)


def test_only_tables_still_read_stay(spark):
    """Of the intermediate tables of a run those that nothing reads any more go."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    docs = [(i, f"{prose(i % 5, 40)} {i % 3}") for i in range(40)]
    found = jaccard_join.jaccard_components(table(spark, docs))
    left = {p.name.rsplit("-", 1)[0].removeprefix("knotwork-") for p in set(folder.iterdir()) - before}
    assert left and not left & {"key-groups", "near", "candidates", "sets", "stars", "rooted", "open", "links-0"}
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(docs)
