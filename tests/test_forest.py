"""The random forest against a plain account of its rule, wherever its nodes are split."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillon.operators import classify
from quillon.operators import forest as forests


def made(spark, n, width, real, seed=0):
    """Rows with labels that depend on two slots, and their dense form."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.3, rng.normal(size=(n, width)).round(2) if real else 1.0, 0.0)
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), (x[:, 0] > 0) + (x[:, 1] > 0))
    rows = [(i * 7, [int(s) for s in np.flatnonzero(v)], [float(e) for e in v[v != 0]], "abc"[c]) for i, (v, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, slots array<bigint>, values array<double>, label string")


def plain(x, y, asked, width, trees, seed, depth):
    """Shares of three classes by trees that are grown row by row, with the operator's draws."""
    edges = []
    for s in range(width):
        values, n = np.unique(x[:, s], return_counts=True)
        ends = np.cumsum(n)
        if not x[:, s].any():
            edges.append([])
        else:
            edges.append([(a + b) / 2 for a, b, e, m in zip(values, values[1:], ends, n) if len(values) <= 32 or e * 32 // len(x) > (e - m) * 32 // len(x)])
    ids, total = forests._mix(np.arange(len(x)) * 7), np.zeros((len(asked), 3))

    def grow(w, key, left):
        n = [int(w[y == c].sum()) for c in range(3)]
        best = None
        if left and sum(c > 0 for c in n) > 1:
            for s in forests._drawn(np.array([key], np.uint64), width, math.ceil(math.sqrt(width)))[0].tolist():
                for e in edges[s]:
                    a = [int(w[(y == c) & (x[:, s] <= e)].sum()) for c in range(3)]
                    b = [i - j for i, j in zip(n, a)]
                    if sum(a) and sum(b) and any(i * sum(n) != j * sum(a) for i, j in zip(a, n)):
                        score = sum(i * i for i in a) / sum(a) + sum(i * i for i in b) / sum(b)
                        if best is None or score > best[0]:
                            best = (score, s, e)
        if best is None:
            return n
        _, s, e = best
        keys = forests._children(np.array([key], np.uint64))
        low, high = grow(w * (x[:, s] <= e), keys[0], left - 1), grow(w * (x[:, s] > e), keys[1], left - 1)
        if isinstance(low, list) and isinstance(high, list) and low.index(max(low)) == high.index(max(high)):
            return n
        return s, e, low, high

    for root in forests._roots(seed, trees):
        tree = grow(forests._times(ids, root), root, depth)
        for i, v in enumerate(asked):
            at = tree
            while isinstance(at, tuple):
                at = at[2] if v[at[0]] <= at[1] else at[3]
            total[i] += np.array(at) / max(1, sum(at))
    return total / total.sum(1, keepdims=True)


def shares(found):
    p = {}
    for r in found.collect():
        p.setdefault(r["query"], {})[r["label"]] = r["p"]
    return np.array([[p[q][c] for c in "abc"] for q in sorted(p)])


@pytest.mark.parametrize(("real", "depth", "most"), [(False, 30, 1 << 25), (False, 30, 12 * 20), (False, 3, 12 * 20), (True, 30, 1 << 25), (True, 30, 12 * 20), (True, 5, 12)])
def test_forest_equals_a_plain_account_wherever_nodes_are_split(spark, monkeypatch, real, depth, most):
    monkeypatch.setattr(forests, "NODE_BYTES", most)
    monkeypatch.setattr(forests, "CHUNK_CELLS", 2000)
    x, y, rows = made(spark, 150, 12, real)
    got = shares(classify.forest(rows, rows.drop("label"), 12, trees=6, seed=5, depth=depth))
    assert got == pytest.approx(plain(x, y, x, 12, 6, 5, depth))


def test_forest_does_not_depend_on_partitions_and_asks_rows_without_slots(spark):
    _, _, rows = made(spark, 80, 9, False)
    asked = rows.drop("label").unionByName(spark.createDataFrame([(9999, [], [])], rows.drop("label").schema))
    one = classify.forest(rows.coalesce(1), asked.coalesce(1), 9, trees=5)
    many = classify.forest(rows.repartition(7, "label"), asked.repartition(5), 9, trees=5)
    got = shares(one)
    assert got.tolist() == shares(many).tolist() and len(got) == 81 and got.sum(1) == pytest.approx(np.ones(81))


def test_forest_learns_what_it_is_given(spark):
    x, y, rows = made(spark, 400, 12, False, 1)
    p = shares(classify.forest(rows.where("id < 2100"), rows.where("id >= 2100").drop("label"), 12, trees=30))
    assert (p.argmax(1) == ((x[300:, 0] > 0) + (x[300:, 1] > 0))).mean() > 0.85


def test_forest_without_any_slot_gives_the_share_of_labels(spark):
    rows = spark.createDataFrame([(i, [], [], "ab"[i % 4 == 0]) for i in range(200)], "id long, slots array<bigint>, values array<double>, label string")
    p = {r["label"]: r["p"] for r in classify.forest(rows, rows.drop("label").limit(1), 5, trees=20).collect()}
    assert p["a"] == pytest.approx(0.75, abs=0.03) and p["a"] + p["b"] == pytest.approx(1)
    assert classify.forest(rows, rows.drop("label").limit(0), 5, trees=2).count() == 0
