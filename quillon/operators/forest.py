"""Random forests over sparse rows. Nodes with many rows are split by counts that tasks make over all rows and Spark adds;
a node whose rows are few enough is finished in one task. No task and no driver holds all rows or the whole forest.

The rule is that of Spark ML's random forest: every tree takes each row a Poisson(1) number of times, a node draws
``ceil(sqrt(width))`` slots, cuts at one of at most 31 thresholds of a slot by the gain in Gini impurity, and two leaves of
one node that predict the same class become one. Draws are hashes of the row's id, or of the node's path, so that the
result depends neither on partitions nor on which nodes are finished in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, ship_package

#: Values of a slot are told apart by at most this many ranges.
BINS = 32
#: A node is finished in one task once its rows, a byte a slot, are at most this.
NODE_BYTES = 32 << 20
#: Bytes of rows that are looked at together, and cells of counts that are made together.
CHUNK_BYTES, CHUNK_CELLS = 4 << 20, 1 << 21
#: Votes are whole numbers of this part.
VOTE = 10**12
#: Chances of a row to be taken at most 0, 1, 2, ... times.
_TAKEN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _mix(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, mixed (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _roots(seed: int, trees: int) -> np.ndarray:
    return _mix(_mix(np.array([seed % (1 << 64)], np.uint64)) + np.arange(trees, dtype=np.uint64))


def _children(keys: np.ndarray) -> np.ndarray:
    return np.stack([_mix(~keys), _mix(~keys ^ np.uint64(1 << 63))], 1).ravel()


def _times(ids: np.ndarray, root: np.uint64) -> np.ndarray:
    """How often the tree takes each row; ``ids`` are mixed."""
    return np.searchsorted(_TAKEN, (_mix(ids ^ root) >> np.uint64(11)) / 2.0**53, side="right")


def _drawn(keys: np.ndarray, width: int, k: int) -> np.ndarray:
    """k different slots for each node, ascending (Floyd's way of drawing)."""
    out = np.empty((len(keys), k), np.int32)
    for i, last in enumerate(range(width - k, width)):
        x = (_mix(keys + np.uint64(i)) % np.uint64(last + 1)).astype(np.int32)
        out[:, i] = np.where((out[:, :i] == x[:, None]).any(1), last, x)
    out.sort(1)
    return out


def _look(x: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.take(x.reshape(-1), rows * x.shape[1] + slots)


def _counts(x: np.ndarray, zero: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, at: np.ndarray, drawn: np.ndarray, bins: int, classes: int) -> np.ndarray:
    """Weights by node, drawn slot, range and class, of ``rows`` (of ``x``, ``y``, ``w``) that are at nodes ``at``.

    Only cells unlike zero are counted one by one, zero has the rest of its node.
    """
    m, k = drawn.shape
    slots = drawn[at]
    cell = _look(x, rows[:, None], slots)
    hit = np.flatnonzero(cell != zero[slots] if zero.any() else cell)
    row, y, w = hit // k, y[rows], w[rows]
    into = ((at[row] * k + hit % k) * bins + cell.reshape(-1)[hit]) * classes + y[row]
    out = np.bincount(into, w[row], m * k * bins * classes).astype(float, copy=False).reshape(m, k, bins, classes)
    total = np.bincount(at * classes + y, w, m * classes).reshape(m, 1, classes)
    out[np.arange(m)[:, None], np.arange(k), zero[drawn]] += total - out.sum(2)
    return out


def _best(counts: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each node's slot (-1: no gain), the last range that goes left, and the weights by class of the left side and of all."""
    m, _, bins, classes = counts.shape
    left = counts.cumsum(2)
    total = left[:, :1, -1:]
    left = left[:, :, :-1]
    right = total - left
    a, b, n = left.sum(3), right.sum(3), total.sum(3)
    gains = (a > 0) & (b > 0) & (left * n[..., None] != total * a[..., None]).any(3)
    score = np.where(gains, (left**2).sum(3) / np.maximum(a, 1) + (right**2).sum(3) / np.maximum(b, 1), -1.0).reshape(m, -1)
    at, own = score.argmax(1), np.arange(m)
    slot = np.where(score[own, at] >= 0, drawn[own, at // (bins - 1)], -1)
    return slot, at % (bins - 1), left.reshape(m, -1, classes)[own, at], total[:, 0, 0]


def _merge(slot: np.ndarray, left: np.ndarray, counts: np.ndarray, nodes: np.ndarray) -> None:
    """Of ``nodes``, in place: one whose two children are leaves of one class becomes a leaf."""
    nodes = nodes[slot[nodes] >= 0]
    a = left[nodes]
    same = (slot[a] < 0) & (slot[a + 1] < 0) & (counts[a].argmax(1) == counts[a + 1].argmax(1))
    slot[nodes[same]] = -1


def _grown(x: np.ndarray, zero: np.ndarray, y: np.ndarray, w: np.ndarray, key: np.uint64, depth: int, bins: int, classes: int, k: int) -> tuple[np.ndarray, ...]:
    """A tree over the rows, all nodes of a level together: ``slot`` (-1: leaf), ``last`` range to the left, ``left`` child
    (the right one follows), ``counts`` by class."""
    rows, at, keys = np.arange(len(x)), np.zeros(len(x), np.int64), np.array([key], np.uint64)
    now = np.bincount(y, w, classes)[None]
    slots, lasts, lefts, counts, levels, base = [], [], [], [], [], 0
    while len(now):
        m = len(now)
        slot, last, left, low = np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros(m, np.int32), np.zeros((m, classes))
        if len(levels) < depth:
            nodes = np.flatnonzero((now > 0).sum(1) > 1)
            starts = np.searchsorted(at, np.arange(m + 1))
            step = max(1, CHUNK_CELLS // (k * bins * classes))
            while len(nodes):
                # As many nodes as have few cells, and not too many rows, together.
                some = nodes[:step]
                some = some[: max(1, int(np.searchsorted(np.cumsum(starts[some + 1] - starts[some]), CHUNK_CELLS // k, side="right")))]
                nodes = nodes[len(some) :]
                part = slice(starts[some[0]], starts[some[-1] + 1])
                number = np.full(some[-1] - some[0] + 1, -1)
                number[some - some[0]] = np.arange(len(some))
                own = number[at[part] - some[0]]
                held, own = rows[part][own >= 0], own[own >= 0]
                drawn = _drawn(keys[some], x.shape[1], k)
                slot[some], last[some], low[some], _ = _best(_counts(x, zero, y, w, held, own, drawn, bins, classes), drawn)
        split = np.flatnonzero(slot >= 0)
        rank = np.full(m, -1)
        rank[split] = np.arange(len(split))
        left[split] = base + m + 2 * np.arange(len(split))
        for all_, one in zip((slots, lasts, lefts, counts, levels), (slot, last, left, now, np.arange(base, base + m))):
            all_.append(one)
        base += m
        rows, at = rows[rank[at] >= 0], at[rank[at] >= 0]
        at = 2 * rank[at] + (_look(x, rows, slot[at]) > last[at])
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        keys = _children(keys[split])
        now = np.stack([low[split], now[split] - low[split]], 1).reshape(-1, classes)
    slot, last, left, counts = (np.concatenate(p) for p in (slots, lasts, lefts, counts))
    for nodes in reversed(levels):
        _merge(slot, left, counts, nodes)
    return slot, last, left, counts


def _walk(x: np.ndarray, rows: np.ndarray, slot: np.ndarray, last: np.ndarray, left: np.ndarray, root: int = 0) -> np.ndarray:
    """The node without children that each of ``rows`` comes to."""
    at, live = np.full(len(rows), root), np.arange(len(rows))
    while True:
        live = live[slot[at[live]] >= 0]
        if not len(live):
            return at
        here = at[live]
        at[live] = left[here] + (_look(x, rows[live], slot[here]) > last[here])


def _votes(counts: np.ndarray) -> np.ndarray:
    """Shares of the classes as whole numbers; none of a node without rows."""
    return np.floor(counts / np.maximum(counts.sum(1, keepdims=True), 1) * VOTE + 0.5).astype(np.int64)


def _dense(codes: pa.Array, zero: np.ndarray) -> np.ndarray:
    """Ranges by row and slot; ``codes`` are the ranges that differ from those of zero."""
    x = np.repeat(zero[None], len(codes), 0)
    code = codes.flatten().to_numpy()
    x[np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy()), code // BINS] = code % BINS
    return x


def _chunks(batches: Iterator[pa.RecordBatch], zero: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, CHUNK_BYTES // len(zero))
    for b in batches:
        for start in range(0, b.num_rows, step):
            part = b.slice(start, step)
            yield part, _dense(part.column("codes"), zero)


def _edges(train: DataFrame, n: int, width: int) -> list[list[float]]:
    """Thresholds of each slot: between all its values if these are few, else between ``BINS`` ranges of about as many rows."""
    held = train.select(F.explode(F.arrays_zip("slots", "values")).alias("e")).select(F.col("e.slots").cast("int").alias("slot"), F.col("e.values").cast("double").alias("v"))
    seen = held.where("v <> 0").groupBy("slot", "v").agg(F.count("*").alias("n"))
    zero = seen.groupBy("slot").agg((F.lit(n) - F.sum("n")).alias("n")).where("n > 0").select("slot", F.lit(0.0).alias("v"), "n")
    own = Window.partitionBy("slot")
    up_to = F.sum("n").over(own.orderBy("v"))
    rows = seen.unionByName(zero).select("slot", "v", F.lead("v").over(own.orderBy("v")).alias("next"), F.count("*").over(own).alias("values"), F.floor(up_to * BINS / n).alias("to"), F.floor((up_to - F.col("n")) * BINS / n).alias("from"))
    rows = rows.where((F.col("values") <= BINS) | (F.col("to") > F.col("from"))).where("next IS NOT NULL")
    edges: list[list[float]] = [[] for _ in range(width)]
    for r in rows.select("slot", ((F.col("v") + F.col("next")) / 2).alias("edge")).orderBy("slot", "edge").collect():
        edges[r["slot"]].append(r["edge"])
    return edges


def _ranged(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """``codes`` (slot times ``BINS`` plus range, where it is not that of zero) instead of ``slots, values``, dealt to all cores."""
    others = [c for c in rows.columns if c not in ("slots", "values")]
    limits = np.full((len(edges), max(1, *map(len, edges))), np.inf)
    for limit, e in zip(limits, edges):
        limit[: len(e)] = e
    zero = (limits < 0).sum(1)

    def run(batches):
        for b in batches:
            slots, v = b.column(0).flatten().to_numpy().astype(np.int64), b.column(1).flatten().to_numpy()
            at = (limits[slots] < v[:, None]).sum(1)
            differs = at != zero[slots]
            ends = np.concatenate([[0], np.cumsum(differs)])[np.concatenate([[0], np.cumsum(b.column(0).value_lengths().to_numpy())])]
            codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((slots * BINS + at)[differs].astype(np.int32)))
            yield pa.record_batch([*b.columns[2:], codes], names=[*others, "codes"])

    schema = T.StructType([rows.schema[c] for c in others]).add("codes", T.ArrayType(T.IntegerType()))
    spread = rows.select(F.col("slots").cast("array<bigint>"), F.col("values").cast("array<double>"), *others).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, schema)


class _Top:
    """The upper nodes of all trees, which tasks get; ``task`` numbers the nodes that are finished in one."""

    def __init__(self, counts: np.ndarray, seed: int):
        n = len(counts)
        self.trees, self.slot, self.last, self.left = n, np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n, np.int64)
        self.counts, self.keys, self.depth, self.task = counts, _roots(seed, n), np.zeros(n, int), np.full(n, -1)

    def split(self, nodes: np.ndarray, slot: np.ndarray, last: np.ndarray, low: np.ndarray) -> None:
        n = len(self.slot)
        self.slot[nodes], self.last[nodes], self.left[nodes] = slot, last, n + 2 * np.arange(len(nodes))
        more = 2 * len(nodes)
        self.slot, self.last, self.left, self.task = (np.concatenate([a, np.full(more, fill, a.dtype)]) for a, fill in ((self.slot, -1), (self.last, 0), (self.left, 0), (self.task, -1)))
        self.counts = np.concatenate([self.counts, np.stack([low, self.counts[nodes] - low], 1).reshape(more, -1)])
        self.keys, self.depth = np.concatenate([self.keys, _children(self.keys[nodes])]), np.concatenate([self.depth, np.repeat(self.depth[nodes] + 1, 2)])

    def walk(self, x: np.ndarray, rows: np.ndarray, tree: int) -> np.ndarray:
        return _walk(x, rows, self.slot, self.last, self.left, tree)


def _taken(batches, zero: np.ndarray, roots: np.ndarray):
    """Of each chunk and tree: ranges and classes of its rows, how often each is taken, and which are."""
    for part, x in _chunks(batches, zero):
        ids, y = _mix(part.column("id").to_numpy()), part.column("y").to_numpy().astype(np.int64)
        for tree, root in enumerate(roots):
            w = _times(ids, root)
            yield part, tree, x, y, w, np.flatnonzero(w)


def _level(fit: DataFrame, top: _Top, nodes: np.ndarray, zero: np.ndarray, bins: int, k: int) -> pd.DataFrame:
    """The best splits of some upper nodes: tasks count over their rows, Spark brings a node's counts together."""
    number = np.full(len(top.slot), -1)
    number[nodes] = np.arange(len(nodes))
    keys, classes, roots = top.keys[nodes], top.counts.shape[1], _roots_of(top)
    shape = (k, bins, classes)

    def count(batches):
        drawn = _drawn(keys, len(zero), k)
        sums = {}
        for _, tree, x, y, w, held in _taken(batches, zero, roots):
            at = number[top.walk(x, held, tree)]
            here = at >= 0
            own, at = np.unique(at[here], return_inverse=True)
            if len(own):
                for node, c in zip(own.tolist(), _counts(x, zero, y, w, held[here], at, drawn[own], bins, classes)):
                    sums[node] = sums[node] + c if node in sums else c
        for node, c in sums.items():
            yield pa.record_batch([pa.array([node]), pa.array([c.tobytes()])], names=["node", "counts"])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        node = int(frame["node"].iloc[0])
        c = sum(np.frombuffer(b).reshape(shape) for b in frame["counts"])
        slot, last, low, _ = _best(c[None], _drawn(keys[node : node + 1], len(zero), k))
        return pd.DataFrame({"node": [node], "slot": slot.astype(int), "last": last.astype(int), "low": [low[0]]})

    found = fit.mapInArrow(count, "node long, counts binary").groupBy("node").applyInPandas(choose, "node long, slot long, last long, low array<double>")
    return found.toPandas().sort_values("node")


def _roots_of(top: _Top) -> np.ndarray:
    return top.keys[: top.trees]


def _root_counts(fit: DataFrame, roots: np.ndarray, classes: int) -> np.ndarray:
    def run(batches):
        sums = np.zeros((len(roots), classes), np.int64)
        for b in batches:
            ids, y = _mix(b.column("id").to_numpy()), b.column("y").to_numpy()
            for tree, root in enumerate(roots):
                sums[tree] += np.bincount(y, _times(ids, root), classes).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "n"])

    out = np.zeros(len(roots) * classes)
    for r in fit.select("id", "y").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(len(roots), classes)


def _by_task(rows: DataFrame, tasks: int, *order) -> DataFrame:
    return rows.repartition(max(1, min(tasks, 16 * rows.sparkSession.sparkContext.defaultParallelism)), "task").sortWithinPartitions("task", *order)


def _finish(fit: DataFrame, top: _Top, nodes: np.ndarray, zero: np.ndarray, bins: int, k: int, depth: int) -> DataFrame:
    """``task, leaf, tree``: the trees below ``nodes``, each grown in one task over its rows, packed."""
    task, roots, classes = top.task, _roots_of(top), top.counts.shape[1]
    keys, deep = top.keys[nodes], depth - top.depth[nodes]

    def deal(batches):
        for part, tree, x, y, w, held in _taken(batches, zero, roots):
            to = task[top.walk(x, held, tree)]
            to, held = to[to >= 0], held[to >= 0]
            if len(to):
                codes = part.column("codes").take(pa.array(held))
                yield pa.record_batch([pa.array(to), pa.array(y[held].astype(np.int32)), pa.array(w[held].astype(np.int32)), codes], names=["task", "y", "w", "codes"])

    def grow(batches):
        def done(t, parts):
            x, y, w = (np.concatenate(p) for p in zip(*parts))
            slot, last, left, counts = _grown(x, zero, y, w, keys[t], int(deep[t]), bins, classes, k)
            packed = b"".join(a.tobytes() for a in (slot, left, counts.astype(np.int32), last))
            return pa.record_batch([pa.array([t]), pa.array([bool(slot[0] < 0)]), pa.array([packed])], names=["task", "leaf", "tree"])

        now, parts = None, []
        for b in batches:
            to = b.column("task").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for start, end in zip(ends, ends[1:]):
                if end > start:
                    if parts and to[start] != now:
                        yield done(now, parts)
                        parts = []
                    now, part = int(to[start]), b.slice(start, end - start)
                    parts.append((_dense(part.column("codes"), zero), part.column("y").to_numpy().astype(np.int64), part.column("w").to_numpy().astype(np.int64)))
        if parts:
            yield done(now, parts)

    dealt = fit.mapInArrow(deal, "task long, y int, w int, codes array<int>")
    return cut(_by_task(dealt, len(nodes)).mapInArrow(grow, "task long, leaf boolean, tree binary"))


def _asked(rows: DataFrame, top: _Top, below: DataFrame, tasks: int, zero: np.ndarray) -> DataFrame:
    """``query`` and a column of votes for each class, several rows a query."""
    task, classes = top.task, top.counts.shape[1]
    names = [f"v{c}" for c in range(classes)]
    votes = "query long, " + ", ".join(f"{c} long" for c in names)
    leaves = np.where((task < 0)[:, None], _votes(top.counts), 0)

    def upper(batches):
        for part, x in _chunks(batches, zero):
            v = sum(leaves[top.walk(x, np.arange(len(x)), tree)] for tree in range(top.trees))
            yield pa.record_batch([part.column("id"), *map(pa.array, v.T)], names=["query", *names])

    done = rows.mapInArrow(upper, votes)
    if not tasks:
        return done

    def deal(batches):
        for part, x in _chunks(batches, zero):
            for tree in range(top.trees):
                to = task[top.walk(x, np.arange(len(x)), tree)]
                held = np.flatnonzero(to >= 0)
                if len(held):
                    taken = part.take(pa.array(held))
                    yield pa.record_batch([pa.array(to[held]), taken.column("id"), taken.column("codes")], names=["task", "query", "codes"])

    def ask(batches):
        now = None
        for b in batches:
            to = b.column("task").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for start, end in zip(ends, ends[1:]):
                if end == start:
                    continue
                part = b.slice(start, end - start)
                if to[start] != now:  # its tree comes first
                    now, packed = to[start], part.column("tree")[0].as_py()
                    n = len(packed) // (9 + 4 * classes)
                    slot, left = np.frombuffer(packed, np.int32, 2 * n).reshape(2, n)
                    v = _votes(np.frombuffer(packed, np.int32, n * classes, 8 * n).reshape(n, classes))
                    last = np.frombuffer(packed, np.uint8, n, (8 + 4 * classes) * n)
                    part = part.slice(1)
                for held, x in _chunks([part], zero):
                    yield pa.record_batch([held.column("query"), *map(pa.array, v[_walk(x, np.arange(len(x)), slot, last, left)].T)], names=["query", *names])

    trees = below.where("NOT leaf").select("task", F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<int>").alias("codes"), "tree")
    dealt = rows.mapInArrow(deal, "task long, query long, codes array<int>").withColumn("tree", F.lit(None).cast("binary"))
    return done.unionByName(_by_task(trees.unionByName(dealt), tasks, F.col("tree").isNull()).mapInArrow(ask, votes))


def forest(train: DataFrame, rows: DataFrame, names: list[str], width: int, trees: int, seed: int, depth: int) -> DataFrame:
    """``query, label, p``: the mean share of each class in the leaves that a row comes to. Inputs: ``id, y, slots, values`` (``y`` a number of ``names``) and ``id, slots, values``; ids are unique."""
    ship_package(train.sparkSession)
    train = train.select("id", F.col("y").cast("int").alias("y"), "slots", "values")
    edges = _edges(train, train.count(), width)
    bins, k, classes = max(2, 1 + max(map(len, edges))), math.ceil(math.sqrt(width)), len(names)
    zero = np.array([sum(e < 0 for e in edge) for edge in edges], np.uint8)
    fit = cut(_ranged(train, edges))
    most = max(1, NODE_BYTES // width)
    top = _Top(_root_counts(fit, _roots(seed, trees), classes), seed)
    fresh = np.arange(trees)
    while True:
        inner = fresh[((top.counts[fresh] > 0).sum(1) > 1) & (top.depth[fresh] < depth)]
        large = top.counts[inner].sum(1) > most
        top.task[inner[~large]] = top.task.max() + 1 + np.arange((~large).sum())
        nodes = inner[large]
        if not len(nodes):
            break
        found = _level(fit, top, nodes, zero, bins, k)
        split = found[found["slot"] >= 0]
        before = len(top.slot)
        if len(split):
            top.split(nodes[split["node"].to_numpy()], split["slot"].to_numpy(), split["last"].to_numpy(), np.stack(split["low"].to_numpy()))
        fresh = np.arange(before, len(top.slot))
    nodes = np.flatnonzero(top.task >= 0)
    nodes = nodes[np.argsort(top.task[nodes])]
    below = None
    if len(nodes):
        below = _finish(fit, top, nodes, zero, bins, k, depth)
        top.task[nodes[[r["task"] for r in below.where("leaf").select("task").collect()]]] = -1
    # Leaves of one class are joined above the tasks too; a node with a task is none.
    slot = np.where(top.task >= 0, 0, top.slot).astype(np.int32)
    for level in range(int(top.depth.max()), -1, -1):
        _merge(slot, top.left, top.counts, np.flatnonzero((top.depth == level) & (top.task < 0)))
    top.slot = np.where(top.task >= 0, -1, slot).astype(np.int32)
    voted = _asked(_ranged(rows.select("id", "slots", "values"), edges), top, below, int((top.task >= 0).sum()), zero)
    sums = voted.groupBy("query").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(classes)])
    all_ = sum((F.col(f"v{c}") for c in range(1, classes)), F.col("v0"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.coalesce(F.col(f"v{c}") / F.nullif(all_, F.lit(0)), F.lit(1 / classes)).alias("p")) for c, n in enumerate(names)]))
    return sums.select("query", each.alias("e")).select("query", "e.label", "e.p")
