"""Overlaps by bit planes against dense rows, and joins of a table with itself."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import bits, dedup, encode, folds, search
from quillon.plans import catalog

VECTOR = "id long, slots array<bigint>, values array<double>"


def made(seed: int, n: int, width: int, most: int = 9) -> tuple[np.ndarray, tuple]:
    """Dense rows of 0 to ``most`` slots, some of them equal, and their packed form with ids out of order."""
    rng = np.random.default_rng(seed)
    m = np.zeros((n, width))
    for row in m:
        row[rng.choice(width, rng.integers(0, most + 1), replace=False)] = 1
    m[n // 2 : n // 2 + 5] = m[0]
    ids = rng.permutation(n)
    part = bits.pack(ids, m[ids].sum(1), np.concatenate([np.flatnonzero(m[i]) for i in ids]), width)
    return m, bits.unpack([part], width)


@pytest.mark.parametrize("own", [1, 8, 10_000])
@pytest.mark.parametrize("metric", search.METRICS)
def test_best_by_bits_equal_dense_rows(monkeypatch, own, metric):
    monkeypatch.setattr(bits, "OWN_GROUP", own)
    m, rows = made(own, 300, 20)
    want = np.clip(search._block_scores(m, m, metric, 20), 0, 1)
    for k, skip in ((1, True), (7, False), (400, True)):
        got = bits.nearest(rows, rows, k, metric, 20, skip).to_pydict()
        at = 0
        for q in range(300):
            order = sorted((r for r in range(300) if not (skip and r == q)), key=lambda r: (-want[q, r], r))[:k]
            assert got["ref"][at : at + len(order)] == order
            assert got["similarity"][at : at + len(order)] == want[q, order].tolist()
            at += len(order)
        assert at == len(got["query"])


@pytest.mark.parametrize("own", [1, 10_000])
def test_limits_by_bits_equal_dense_rows(monkeypatch, own):
    monkeypatch.setattr(bits, "OWN_GROUP", own)
    monkeypatch.setattr(bits, "PAIR_ROWS", 50)
    m, rows = made(3, 250, 30)
    for metric in search.METRICS:
        want = np.clip(search._block_scores(m, m, metric, 30), 0, 1)
        got = {(q, r): s for b in bits.above(rows, rows, metric, 30, 0.4) for q, r, s in zip(*b.to_pydict().values())}
        assert got == {(q, r): want[q, r] for q, r in zip(*np.nonzero(want >= 0.4))}
    shared = (m @ m.T).astype(int)
    union = (m.sum(1)[:, None] + m.sum(1)[None, :]).astype(int) - shared
    for percent in (30, 75, 100):
        got = [tuple(x) for b in bits.linked(rows, rows, 30, percent, True) for x in zip(*b.to_pydict().values())]
        want = [(a, b, shared[a, b], union[a, b]) for a in range(250) for b in range(a + 1, 250) if union[a, b] and 100 * shared[a, b] >= percent * union[a, b]]
        assert sorted(got) == want and len(got) == len(set(got))


def test_search_refuses_what_is_not_binary(spark):
    for row in ((1, [3], [2.0]), (1, [9], [1.0])):
        with pytest.raises(Exception, match="ones only|outside the width"):
            search.nearest(spark.createDataFrame([row], VECTOR), spark.createDataFrame([row], VECTOR), 1, "jaccard", 8).collect()


def test_search_without_rows(spark):
    some, none = spark.createDataFrame([(1, [3], [1.0])], VECTOR), spark.createDataFrame([], VECTOR)
    assert search.nearest(some, none, 3, "jaccard", 8).count() == search.nearest(none, some, 3, "jaccard", 8).count() == 0


def test_pairs_of_blocks_meet_once_and_join_no_items(spark, monkeypatch):
    """Several blocks of references, each parted for the queries; sets of items too large for bitmaps give the same."""
    monkeypatch.setattr(bits, "MOST_REFERENCES", 64)
    monkeypatch.setattr(search, "LEAST_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist())) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, kcs array<bigint>")
    found = dedup.similar_pairs(frame, 50)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    sets = [set(x) for _, x in rows]
    want = [(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in range(200) for b in range(a + 1, 200) if sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])]
    assert got == want
    far = frame.selectExpr("id", "transform(kcs, x -> x + 1000000) AS kcs")
    assert sorted(map(tuple, dedup.similar_pairs(far, 50).collect())) == want


def test_classes_without_pairs_skip_the_rounds(spark, monkeypatch):
    asked = []
    rounds = dedup.exemplars
    monkeypatch.setattr(dedup, "exemplars", lambda ids, edges, by=(): asked.append(ids.count()) or rounds(ids, edges, by))
    rows = [(0, [1, 2, 3, 4]), (1, [9]), (2, [1, 2, 3, 5]), (3, [9]), (4, []), (5, [7, 8])]
    got = {(r["percent"], r["id"]): r["leader"] for r in dedup.leader_clusters(spark.createDataFrame(rows, "id long, kcs array<bigint>"), [60, 90]).collect()}
    assert got == {(60, 0): 0, (60, 1): 1, (60, 2): 0, (60, 3): 1, (60, 4): 4, (60, 5): 5, (90, 0): 0, (90, 1): 1, (90, 2): 2, (90, 3): 1, (90, 4): 4, (90, 5): 5}
    assert asked == [4]


@pytest.mark.parametrize(("inputs", "fan_in"), [(5, 5), (40, 3), (1, 1)])
def test_drawn_projection_shuffles_nothing(spark, inputs, fan_in):
    import hashlib

    edges = encode.random_edges(spark, inputs, 60, fan_in, 7)
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()
    want = []
    for kc in range(60):
        draws = [int(hashlib.md5(f"7|{kc}|{a}".encode()).hexdigest()[:8], 16) % inputs for a in range(4 * fan_in + 16)]
        want += [(pn, kc) for pn in list(dict.fromkeys(draws))[:fan_in]]
    assert sorted(map(tuple, edges.collect())) == sorted(want)


def test_cosine_pairs_of_blocks_equal_all_pairs(spark, monkeypatch):
    """Several blocks, pieces and comparisons; values of both signs, real ones and zeros; nothing is joined by slots."""
    for name, value in (("FOLDS", 8), ("QUERY_ROWS", 7), ("REFERENCE_ROWS", 11), ("PAIRS", 13)):
        monkeypatch.setattr(folds, name, value)
    rng = np.random.default_rng(6)
    m = np.where(rng.random((120, 30)) < 0.2, rng.integers(-3, 9, (120, 30)), 0.0)
    m[60:90] = m[:30] * 2 + np.where(rng.random((30, 30)) < 0.03, 1, 0)
    m[5] = 0
    length = np.sqrt((m * m).sum(1))
    want = m @ m.T / np.where(length > 0, length, 1)[:, None] / np.where(length > 0, length, 1)[None, :]
    sparse = [(i, np.flatnonzero(r), r[r != 0]) for i, r in enumerate(m)]
    parts = [folds.Rows(np.array([i for i, _, _ in some]), np.array([len(s) for _, s, _ in some]), np.concatenate([s for _, s, _ in some]), np.concatenate([v for _, _, v in some])) for some in (sparse[::2], sparse[1::2])]
    one, other = (folds.unpack([p.pack()]) for p in parts)
    found = [x for q, r, same in ((one, one, True), (one, other, False), (other, other, True)) for b in folds.linked(q, r, 0.6, same) for x in zip(*b.to_pydict().values())]
    assert {(a, b) for a, b, _ in found} == {(a, b) for a in range(120) for b in range(a + 1, 120) if want[a, b] >= 0.6} and len(found) == len({x[:2] for x in found})
    assert all(s == pytest.approx(want[a, b]) for a, b, s in found)
    frame = spark.createDataFrame([(i, s.tolist(), v.tolist()) for i, s, v in sparse], VECTOR)
    pairs = dedup.similar_vectors(frame, 60)
    assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["early"], r["late"]) for r in pairs.collect()} == {x[:2] for x in found}


@pytest.mark.parametrize("name", ["bridge_activation", "bridge_fingerprint"])
def test_bridge_brings_rows_together_once(spark, data, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(id") == 1 and "SortMergeJoin" not in plan
