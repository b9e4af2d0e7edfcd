"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct word shingles. Documents are linked when the Jaccard similarity of their
full sets reaches the threshold (in whole numbers: ``100 * intersection >= percent * union``); the result is
the connected components of all links.

The forest. A signature holds ``HASHES`` minima. Each of ``TREES`` trees has an order of its own: all signatures
sorted from the tree's own place on (the signature rotated by ``HASHES / TREES`` places a tree). Documents with a
long common prefix stand side by side, and a document's candidates are its neighbours on both sides. A region is
a stretch of a tree with a common prefix. Its depth adapts: from the least of ``DEPTHS`` a region is parted at
the next depth for as long as it has more than ``REGION`` members; what agrees in all minima is parted by a hash
of the member, another one in each tree. Regions of up to ``NEXT + 1`` members make all their pairs, larger ones
those of next neighbours, so that the number of candidates is in proportion to the members.

Nothing is lost by that bound. Once components are known, all regions of the least depth are finished, whatever
their size: every node outside a region's largest component is compared with all its members that are not
connected to it yet (but for those that the estimate rules out), on full sets. Regions too large for a task are laid
out in cells, a block of members by a chunk of the nodes that ask; only links leave a cell, one for each two
components that it connects. Trees are finished in ``ROUNDS``, since each round leaves the later ones fewer nodes that
ask. Two sets at similarity 0.85 share a region of depth 3 in no tree with probability 1e-10, at 0.8 with 4e-8.

Plan. Texts are read by one task pass into signatures; equal sets are collapsed by digest (pre-aggregated),
so thousands of copies are one node. Candidates with a signature estimate far below the threshold go; estimates
compare one byte of each minimum. Only documents in a candidate pair or a crowded region are read again for their
full sets, which are written to the shared folder; every link is confirmed on full sets. Components come from
contraction rounds (every node joins its smallest neighbour, edges are mapped and deduplicated), each cut in the
shared folder. Nothing is collected to the driver or broadcast by hint.

Defined results. Words are the runs without ASCII white space, A-Z lower-cased. A text with fewer words than
a shingle is one shingle; a null or empty text, or one of white space only, has no shingles and no links.
A null id ranks after all others as the smallest of a component. Rows that repeat an id are rows of their
own. A very long text is one row of a task, with 8 bytes a shingle. Extra columns are ignored by
:func:`near_groups`; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, cut, ship_package, text_or_empty

#: The forest: minima in a signature, trees, depths of a region, members before a region is parted, neighbours to each side.
HASHES, TREES, DEPTHS, REGION, NEXT = 96, 24, (3, 6, 12, 24, 96), 1000, 2
#: Neighbours to each side in a region of more than NEXT + 1 members: those regions are finished afterwards.
FEW = 1
#: A candidate whose estimate lies this far below the threshold (over five standard errors) goes.
SLACK = 0.2
#: Trees finished together; nodes, and shingles, of a block or chunk of a cell.
ROUNDS, BLOCK, SETS = (range(0, 2), range(2, TREES)), 1000, 4 << 20
#: Edges or labels of a task while components are found.
LINKS = 50_000
#: Bytes of text taken at a time.
CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and of each text the number of its words."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.r_[0, np.cumsum(size)]
    counts = np.diff(np.searchsorted(start, bounds))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    total = np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))
    total = np.r_[np.uint64(0), total]
    own = (total[end] - total[start]) * _powers(_INVERSE, len(data))[start]
    return _mix(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    words, counts = word_hashes(texts)
    factor = np.uint64(0xA0761D6478BD642F)
    full = words.copy()
    for k in range(1, width):
        full[:-k] = _mix(full[:-k] * factor + words[k:])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(full[at : at + n - width + 1]))
        elif n:
            h = words[at : at + 1].copy()
            for k in range(1, n):
                h = _mix(h * factor + words[at + k : at + k + 1])
            out.append(_mix(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """One row of minima a set; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), hashes), np.uint32)
    a, c = _family(hashes)
    for i in range(hashes):
        out[:, i] = np.minimum.reduceat(((flat * a[i] + c[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out.view(np.int32)


def _chunks(batches, at: int):
    """(rows of a batch, texts as bytes) of about ``CHUNK`` bytes."""
    for b in batches:
        texts = b.column(at).cast(pa.large_binary()).to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j])
                j += 1
            yield b.slice(i, j - i), texts[i:j]
            i = j


def _sign(width: int, id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("n", pa.int64()), ("node", pa.binary()), ("sig", pa.list_(pa.int32())), ("sketch", pa.binary())])

    def run(batches):
        for b, texts in _chunks(batches, 1):
            sets = shingle_sets(texts, width)
            full = [s for s in sets if len(s)]
            sig = signatures(full) if full else np.zeros((0, HASHES), np.int32)
            row = np.cumsum([len(s) > 0 for s in sets])
            offsets = np.r_[0, row * HASHES].astype(np.int32)
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            low = iter(sig.astype(np.uint8))
            sketches = [next(low).tobytes() if n is not None else None for n in nodes]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel())), pa.array(sketches, pa.binary())], schema=schema)

    return run


def _full(width: int):
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for b, texts in _chunks(batches, 1):
            sets = shingle_sets(texts, width)
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return run


def _placed(nodes: DataFrame, level: int, trees: range = range(TREES)) -> DataFrame:
    """``tree, node, region, above, place0, place2``: every node in every tree, by its region at a level of ``DEPTHS`` and the region around it."""
    step, depth = HASHES // TREES, DEPTHS[level]
    rows = nodes.select("node", "sig", F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree"))
    at = lambda i: F.element_at("sig", F.pmod(F.col("tree") * step + i, F.lit(HASHES)) + 1)
    name = lambda k: F.xxhash64("tree", *[at(i) for i in range(DEPTHS[k])])
    above = name(level - 1) if level else F.lit(None).cast("long")
    # The order within a region: the next four minima, two in a number.
    two = lambda i: F.call_function("shiftleft", at(i).cast("long"), F.lit(32)) + at(i + 1).cast("long")
    places = [(two(i) if i + 1 < HASHES else F.lit(0).cast("long")).alias(f"place{i - depth}") for i in (depth, depth + 2)]
    return rows.select("tree", "node", name(level).alias("region"), above.alias("above"), *places)


def forest(nodes: DataFrame, stage: Staged) -> tuple[DataFrame, DataFrame]:
    """``level, tree, region, node, place0, place2`` of every node in its region of fitting depth in every tree; and the ``region`` of
    the least depth that were too large."""
    out, above, first = None, None, None
    for level in range(len(DEPTHS)):
        rows = _placed(nodes, level)
        if above is not None:
            rows = rows.join(above.withColumnRenamed("region", "above"), "above", "left_semi")
        crowded = rows.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > REGION)
        crowded = stage.write(crowded, "near-crowded")
        first = crowded.select("region") if first is None else first
        if crowded.isEmpty():
            fit, done = rows, True
        elif level + 1 < len(DEPTHS):
            fit, done = rows.join(crowded.select("region"), "region", "left_anti"), False
        else:
            part = F.pmod(F.xxhash64("node", "tree"), F.coalesce(F.ceil(F.col("members") / REGION), F.lit(1)).cast("long"))
            fit, done = rows.join(crowded, "region", "left").withColumn("region", F.xxhash64("region", part)), True
        fit = fit.select(F.lit(level).alias("level"), "tree", "region", "node", "place0", "place2")
        out = fit if out is None else out.unionByName(fit)
        if done:
            break
        above = crowded.select("region")
    return out, first


def neighbours(rows: DataFrame) -> DataFrame:
    """``level, tree, region, node, members, next``: the following nodes in the region's order, of regions with company."""
    order = Window.partitionBy("region").orderBy("place0", "place2", "node")
    after = [F.lead("node", i).over(order).alias(f"n{i}") for i in range(1, NEXT + 1)]
    out = rows.select("level", "tree", "region", "node", F.count("*").over(Window.partitionBy("region")).alias("members"), *after)
    ahead = F.array_compact(F.array(*[f"n{i}" for i in range(1, NEXT + 1)]))
    ahead = F.when(F.col("members") <= NEXT + 1, ahead).otherwise(F.slice(ahead, 1, FEW))
    return out.where("members > 1").select("level", "tree", "region", "node", "members", ahead.alias("next"))


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many bytes rows of sketches (or a row and many) agree."""
    same = np.ascontiguousarray(one == two).view(np.uint64)
    return (same.sum(-1) * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES)


def _likely(least: float):
    def run(batches):
        for b in batches:
            keep = _agreeing(_sketches(b.column(2)), _sketches(b.column(3))) >= least * HASHES if b.num_rows else np.zeros(0, bool)
            yield pa.record_batch([b.column(i) for i in range(2)], names=["a", "b"]).filter(pa.array(keep))

    return run


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``a, b`` of the pairs whose sketches agree in at least this share of their minima."""
    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    both = one.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_likely(least), "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose full sets reach the threshold."""
    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where(shared.cast("long") * 100 >= union.cast("long") * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in a link: the same label in a component (not always its smallest node).

    Tasks are as many as the edges left need: most rounds have few, and a task for each shuffle partition would cost more than its rows.
    """
    cores = links.sparkSession.sparkContext.defaultParallelism
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    steps = []
    while n := edges.count():
        fit = lambda df, n=n: df.coalesce(max(cores, -(-n // LINKS)))
        edges = fit(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = fit(fit(both).groupBy("a").agg(F.min("b").alias("low"))).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
        # One jump: the label's own label.
        jump = small.select(F.col("node").alias("label"), F.col("label").alias("next"))
        small = cut(fit(small.join(jump, "label").select("node", F.col("next").alias("label"))))
        steps.append((small, fit))
        left = fit(edges.join(small.select(F.col("node").alias("a"), F.col("label").alias("la")), "a"))
        left = fit(left.join(small.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"))
        edges = cut(fit(left.where("la <> lb").select(*_pair(F.col("la"), F.col("lb"))).distinct()))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    known, fit = steps[0]
    for small, _ in steps[1:]:
        step = small.select(F.col("node").alias("label"), F.col("label").alias("next"))
        known = fit(known.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    return cut(known) if len(steps) > 1 else known


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after further links: only the labels they connect are worked on, not the old links again."""
    one, two = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    met = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    step = components(met.where("la <> lb").select(*_pair(F.col("la"), F.col("lb")))).select(F.col("node").alias("label"), F.col("label").alias("next"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return cut(labels.unionByName(new).join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _by_cell(batches):
    """(cell, rows) of batches ``cell, node, label, asks, member, sketch[, shingles]`` sorted by cell; a row is one of their tuples."""
    cell, rows = None, []
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(6)]
        if b.num_columns > 6:
            flat = b.column(6).flatten().to_numpy()
            at = np.r_[0, np.cumsum(b.column(6).value_lengths().fill_null(0).to_numpy())]
            columns.append([flat[at[i] : at[i + 1]] for i in range(b.num_rows)])
        for row in zip(*columns):
            if row[0] != cell:
                if rows:
                    yield cell, rows
                cell, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield cell, rows


def _layout(rows: list[tuple]):
    """Components as small numbers, the rows that ask, those that are asked, and all sketches."""
    kind = np.unique(np.array([r[1] for r in rows], dtype=object), return_inverse=True)[1]
    asks, member = (np.flatnonzero([r[i] for r in rows]) for i in (2, 3))
    return kind, asks, member, np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), HASHES)


def _alike(least: float):
    """The rows of a cell that a node of another component may be linked with, by the estimate."""
    names = ["cell", "node", "label", "asks", "member", "sketch"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary()]

    def run(batches):
        for cell, rows in _by_cell(batches):
            kind, asks, member, sketch = _layout(rows)
            own, wanted = sketch[member], np.zeros(len(rows), bool)
            for x in asks.tolist():
                like = (kind[member] != kind[x]) & (_agreeing(own, sketch[x]) >= least * HASHES)
                wanted[member[like]] = True
                wanted[x] |= like.any()
            at = np.flatnonzero(wanted).tolist()
            yield pa.record_batch([pa.array([cell] * len(at), kinds[0]), *(pa.array([rows[i][j] for i in at], kinds[j + 1]) for j in range(5))], names=names)

    return run


def _shared(asks: np.ndarray, member: np.ndarray, sets: list[np.ndarray]):
    """Row by row of ``asks``: the sizes of its intersections with all of ``member``.

    Two ways to the same numbers, by cost: a product of 0/1 matrices over the shingles that occur more than once,
    some thousand columns at a time, or marks over all shingles. The first wins where many rows are nearly alike.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    _, words, uses = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    common = uses > 1
    n = int(common.sum())
    if n * len(member) < 50 * size[member].sum():
        renamed = np.cumsum(common) - 1
        keep = common[words]
        column, row = renamed[words[keep]], row[keep]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        total = np.zeros((len(asks), len(member)), np.float32)
        for at in range(0, n, 4096):
            i, j = np.searchsorted(column, [at, at + 4096])
            table = np.zeros((len(sets), min(4096, n - at)), np.float32)
            table[row[i:j], column[i:j] - at] = 1
            total += table[asks] @ table[member].T
        yield from total.astype(np.int64)
        return
    start = np.cumsum(size) - size
    mark = np.zeros(len(uses), np.int64)
    for x in asks.tolist():
        own = words[start[x] : start[x] + size[x]]
        mark[own] = 1
        yield np.add.reduceat(mark[words], start)[member]
        mark[own] = 0


def _linked(percent: int):
    """Links of a cell's components on full sets: every node that asks is compared with every member that is not connected to
    it yet; one link is told for each two components that meet."""

    def links(rows: list[tuple]):
        kind, asks, member, _ = _layout(rows)
        sets = [r[5] for r in rows]
        size = np.array([len(x) for x in sets], np.int64)
        for x, shared in zip(asks.tolist(), _shared(asks, member, sets)):
            enough = member[100 * shared >= percent * (size[member] + size[x] - shared)]
            for y in enough[kind[enough] != kind[x]].tolist():
                if kind[y] != kind[x]:
                    kind[kind == kind[y]] = kind[x]
                    yield min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])

    def run(batches):
        for _, rows in _by_cell(batches):
            found = list(links(rows)) if any(r[2] for r in rows) and any(r[3] for r in rows) else []
            yield pa.record_batch([pa.array([p[i] for p in found], pa.binary()) for i in range(2)], names=["a", "b"])

    return run


def cells(rows: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cell, node, label, asks, member, sketch``: regions (``region, node``) with more than one component, laid out for tasks.

    The nodes outside a region's largest component ask. Blocks of members and chunks of nodes that ask have about ``BLOCK``
    nodes and ``SETS`` shingles at most; a region that fits is one cell.
    """
    named = nodes.select("node", "n").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n")
    sized = rows.join(named, "node").select("node", "region", "label", "n")
    kinds = sized.groupBy("region", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    top = F.max(F.struct("c", "label", "s")).alias("top")
    mixed = kinds.groupBy("region").agg(F.count("*").alias("kinds"), F.sum("c").alias("c"), F.sum("s").alias("s"), top).where("kinds > 1")
    pieces = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / SETS), F.lit(1)).cast("long")
    mixed = mixed.select("region", F.col("top.label").alias("largest"), pieces(F.col("c"), F.col("s")).alias("blocks"), pieces(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("chunks"))
    rows = sized.join(mixed, "region").join(nodes.select("node", "sketch"), "node").withColumn("asks", F.col("label") != F.col("largest"))
    own = lambda n: F.pmod(F.xxhash64("node", "region"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda i, j, asks, member: F.struct(F.xxhash64("region", i, j).alias("cell"), asks.alias("asks"), member.alias("member"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    asked = F.transform(upto("chunks"), lambda j: cell(own("blocks"), j, no, yes))
    asking = F.transform(upto("blocks"), lambda i: cell(i, own("chunks"), yes, no))
    single = F.array(cell(zero, zero, F.col("asks"), yes))
    places = F.when((F.col("blocks") == 1) & (F.col("chunks") == 1), single).when(F.col("asks"), F.concat(asked, asking)).otherwise(asked)
    return rows.select("node", "label", "sketch", F.explode(places).alias("p")).select("p.cell", "node", "label", "p.asks", "p.member", "sketch")


def finished(rows: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, percent: int, stage: Staged) -> DataFrame:
    """``a, b``: links between the components that meet in regions (``region, node``). No candidates are written: estimates and
    full sets are compared where a cell's rows are."""
    columns = "cell long, node binary, label binary, asks boolean, member boolean, sketch binary"
    at_cell = lambda df: df.repartition("cell").sortWithinPartitions("cell", "node")
    wanted = stage.write(at_cell(cells(rows, labels, nodes)).mapInArrow(_alike(least), columns), "near-alike")
    _release(rows.sparkSession)
    return at_cell(wanted.join(sets, "node").select(*wanted.columns, "shingles")).mapInArrow(_linked(percent), "a binary, b binary").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component`` (the smallest id reachable by links)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship_package(spark)
    stage = Staged(spark)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    kind = source.schema["key"].dataType
    schema = T.StructType().add("key", kind).add("n", "long").add("node", "binary").add("sig", T.ArrayType(T.IntegerType())).add("sketch", "binary")
    signed = stage.write(source.mapInArrow(_sign(width, to_arrow_type(kind)), schema), "near-signatures")
    rows = signed.select("key", "n", "node")
    nodes = stage.write(signed.where("node IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "near-nodes")
    placed, crowded = forest(nodes, stage)
    near = stage.write(neighbours(placed), "near-neighbours")
    # Regions of the least depth to be finished, of some trees: those with more members than make all their pairs.
    large = lambda trees: near.where((F.col("level") == 0) & (F.col("members") > NEXT + 1) & F.col("tree").isin(*trees)).select("region", "node").unionByName(_placed(nodes, 0, trees).join(crowded, "region", "left_semi").select("region", "node"))
    least = percent / 100 - SLACK
    first = near.where("size(next) > 0").select(F.explode("next").alias("other"), "node")
    pairs = first.select(*_pair(F.col("node"), F.col("other"))).distinct()
    pairs = stage.write(estimated(pairs, nodes, least), "near-pairs")
    _release(spark)
    # Full sets of the documents that are in a pair or in a region to be finished, one document a node.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large(range(TREES)).select("node")).distinct()
    reps = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("rep")).join(wanted, "node", "left_semi")
    texts = source.join(reps.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("rep"))).select("node", "text")
    # Rows that repeat an id with other texts give sets of other nodes: those are not the wanted ones.
    full = texts.mapInArrow(_full_checked(width), "node binary, shingles array<bigint>").dropDuplicates(["node"])
    sets = stage.write(full, "near-sets")
    _release(spark)
    labels = components(confirmed(pairs, sets, percent))
    for trees in ROUNDS:
        found = stage.write(finished(large(trees), labels, nodes, sets, least, percent, stage), "near-links")
        if not found.isEmpty():
            labels = extended(labels, found)
    named = rows.join(labels, "node", "left").select("key", "n", F.coalesce("label", "node").alias("label"))
    lowest = named.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("low"))
    linked = named.where("label IS NOT NULL").join(lowest, "label").select("key", F.col("n").alias("n_shingles"), F.col("low").alias("component"))
    alone = named.where("label IS NULL").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("component"))
    return linked.unionByName(alone)


def _full_checked(width: int):
    """As ``_full``, but only sets whose digest is the node they are wanted for."""
    make = _full(width)

    def run(batches):
        for b in make(batches):
            flat, offsets = b.column(1).flatten().to_numpy(), b.column(1).offsets.to_numpy()
            names = b.column(0).to_pylist()
            keep = [xxhash.xxh3_128_digest(flat[offsets[i] : offsets[i + 1]].tobytes()) == names[i] for i in range(len(names))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group (its smallest id), with all their columns."""
    groups = near_groups(docs, id_col, text_col, width, percent)
    keep = groups.where(F.col("key").eqNullSafe(F.col("component"))).select(F.col("key").alias("__key")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__key")), "left_semi")
