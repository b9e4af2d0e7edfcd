"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors are quantised to integers, floor(256 * x), so scores are exact and ties are real ties. Vectors are first
dealt to cells around pivots; a cell is a ball (pivot, radius), and its vectors make one or more shards of bounded
size. Each shard builds a ball tree (split along the direction between two far points, until a leaf holds ``LEAF``
vectors); every node keeps its centre and radius, and a query's best possible score in a node or cell is
``q . centre + |q| * radius``. A block of queries visits a shard's nodes in the order of that bound and stops where no
query's bound reaches its k-th score so far.

The k-th score is shared: each query first searches one shard of each of the ``FIRST`` cells nearest to its direction;
the scores found are its starting threshold everywhere else. Then it is sent only to the cells whose bound reaches
that threshold. Within a shard the threshold rises from leaf to leaf.

Plan. The pivots (at most ``PIVOTS``, a sample by hash; every row is indexed) and the cells' radii go to all tasks, which
bound every query against every cell without a join. Only surviving (query, cell) rows are shuffled; they are packed
into arrays of bounded bytes, as are the shards, and joined by shard. Per query and shard only k rows leave a task.

Defined results. Vectors that are null, empty or hold a null or non-finite component take no part. Vectors of different
lengths have no inner product: each length is searched by itself. A query's own row (same id) is no candidate. Ties
go to the smaller id; a query with fewer than k candidates gets them all. Rows that repeat both id and vector count
once; of a query id with several vectors the smallest asks. Null ids take no part. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, ship_package

#: Vectors in a leaf; bytes of a shard and of a block of queries; pivots of a length at most.
LEAF, SHARD_BYTES, BLOCK_BYTES, PIVOTS = 64, 2 << 20, 1 << 20, 1024
SCALE = 256
#: Cells of which each query searches one shard first; the scores found there are its starting threshold.
FIRST = 2


class BallTree:
    """Nodes in arrays; a leaf is a stretch of ``order``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        nodes: list[tuple[int, int, int, int]] = []  # begin, end, left, right

        def far(points: np.ndarray, start: np.ndarray) -> np.ndarray:
            return points[np.argmax(((points - start) ** 2).sum(1))]

        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            at = len(nodes)
            nodes.append((a, b, -1, -1))
            if parent >= 0:
                n = list(nodes[parent])
                n[2 + side] = at
                nodes[parent] = tuple(n)
            if b - a <= leaf:
                continue
            points = vectors[order[a:b]]
            one = far(points, points.mean(0))
            two = far(points, one)
            if (one == two).all():  # all alike: one leaf
                continue
            along = points @ (two - one)
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, m)]
            stack += [(a, a + m, at, 0), (a + m, b, at, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes = np.array(nodes, np.int64)
        self.centre = np.array([self.vectors[a:b].mean(0) for a, b, _, _ in nodes])
        self.radius = np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(1).max()) for (a, b, _, _), c in zip(nodes, self.centre)])

    def search(self, qids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the ids and scores of its best k here that reach ``kth``; a lack is id -1. Also the raised ``kth``."""
        norm = np.sqrt((queries**2).sum(1))
        leaves = np.flatnonzero(self.nodes[:, 2] < 0)
        best_id = np.full((len(qids), k), -1, np.int64)
        best = np.full((len(qids), k), -np.inf)
        kth = kth.copy()
        #: Rounding of the bound, which is in floating point; scores themselves are whole numbers.
        slack = 1e-6 * (1 + norm * (np.abs(self.centre).max() * np.sqrt(self.centre.shape[1]) + self.radius.max()))
        bound = queries @ self.centre.T + norm[:, None] * self.radius + slack[:, None]
        # Branch: a leaf is open to a query if every node above it is.
        open_ = bound >= kth[:, None]
        for at, (_, _, left, right) in enumerate(self.nodes.tolist()):
            if left >= 0:
                for child in (left, right):
                    open_[:, child] &= open_[:, at]
                    bound[:, child] = np.minimum(bound[:, child], bound[:, at])
        for leaf in leaves[np.argsort(-bound[:, leaves].max(0), kind="stable")].tolist():
            live = np.flatnonzero(open_[:, leaf] & (bound[:, leaf] >= kth))
            if not len(live):
                continue
            a, b = self.nodes[leaf, :2]
            ids = self.ids[a:b]
            scores = queries[live] @ self.vectors[a:b].T
            scores[ids[None, :] == qids[live][:, None]] = -np.inf
            scores[scores < kth[live][:, None]] = -np.inf
            some = np.isfinite(scores).any(1)
            if not some.any():
                continue
            live, scores = live[some], scores[some]
            all_scores = np.concatenate([best[live], scores], 1)
            all_ids = np.concatenate([best_id[live], np.broadcast_to(ids, scores.shape)], 1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[live] = np.take_along_axis(all_scores, order, 1)
            best_id[live] = np.take_along_axis(all_ids, order, 1)
            kth[live] = np.maximum(kth[live], best[live, k - 1])
        best_id[~np.isfinite(best)] = -1
        return best_id, best, kth


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: the vectors that take part, as whole numbers."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    return good.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _per(bytes_: int, width: int) -> int:
    """Rows of this many numbers in so many bytes."""
    return max(1, bytes_ // (8 * width + 32))


def pivots(rows: DataFrame, widths: dict[int, int]) -> dict[int, np.ndarray]:
    """Of every length of vectors a bounded sample by hash: about one a shard, at most ``PIVOTS``."""
    want = {w: min(PIVOTS, max(1, -(-n // _per(SHARD_BYTES, w)))) for w, n in widths.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for p in want.items() for x in p]), F.size("v"))
    order = Window.partitionBy(F.size("v")).orderBy(F.md5(F.col("id").cast("string")), "id", "v")
    # The window's first rows are kept by partition before they are shuffled.
    found = rows.withColumn("n", F.row_number().over(order)).where((F.col("n") <= PIVOTS) & (F.col("n") <= limit)).select("v").collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {w: np.array(v) for w, v in out.items()}


def _by_width(batch: pa.RecordBatch, at: int):
    """(row numbers, matrix) of the vectors of each length in a batch."""
    lengths = batch.column(at).value_lengths().to_numpy()
    for w in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == w)
        yield w, rows, batch.column(at).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), w)


def _assign(centres: dict[int, np.ndarray]):
    """``id, v, cell, far``: the nearest pivot (numbered within its length) and the distance to it."""

    def run(batches):
        for b in batches:
            cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for w, rows, x in _by_width(b, 1):
                p = centres[w]
                d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
                cell[rows] = d.argmin(1)
                far[rows] = np.sqrt(((x - p[cell[rows]]) ** 2).sum(1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    return run


def _sent(centres: dict[int, np.ndarray], radius: dict[int, np.ndarray], shards: dict[int, np.ndarray], first: bool):
    """``id, v, kth, cell, part``: every query with the shards that it has to search: first one of each of the cells nearest
    to its direction, then all of the cells whose bound reaches its ``kth``."""
    names = ["id", "v", "kth", "cell", "part"]

    def run(batches):
        for b in batches:
            ids, kth = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            for w, rows, x in _by_width(b, 1):
                p, parts = centres[w], shards[w]
                along = x @ p.T
                norm = np.sqrt((x * x).sum(1))
                live = parts > 0
                if first:
                    n = min(FIRST, int(live.sum()))
                    cell = np.argsort(np.where(live, -along, np.inf), axis=1, kind="stable")[:, :n]
                    q, cell = np.repeat(np.arange(len(rows)), n), cell.ravel()
                    part = ids.take(pa.array(rows)).to_numpy()[q] % parts[cell]
                else:
                    slack = 1e-6 * (1 + norm * (np.abs(p).max(initial=0) * np.sqrt(w) + radius[w].max(initial=0)))
                    q, cell = np.nonzero(live & (along + norm[:, None] * radius[w] + slack[:, None] >= kth[rows][:, None]))
                    n = parts[cell]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    q, cell = np.repeat(q, n), np.repeat(cell, n)
                at = rows[q]
                for i in range(0, len(at), 4096):
                    take = pa.array(at[i : i + 4096])
                    yield pa.record_batch([ids.take(take), b.column(1).take(take), b.column(2).take(take), pa.array(cell[i : i + 4096].astype(np.int32)), pa.array(part[i : i + 4096].astype(np.int32))], names=names)

    return run


def _unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        last, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name = tuple(batch.column(j)[i].as_py() for j in range(3))
                if name != last:
                    ids, vectors = _unpack(batch.column(3).slice(i, 1).flatten())
                    last, tree = name, BallTree(ids, vectors)
                block = batch.column(4).slice(i, 1).flatten()
                qids, queries = _unpack(block)
                found, scores, _ = tree.search(qids, queries, block.field("kth").to_numpy(zero_copy_only=False), k)
                r, c = np.nonzero(np.isfinite(scores))
                yield pa.record_batch([pa.array(qids[r]), pa.array(found[r, c]), pa.array(scores[r, c].astype(np.int64))], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every row for which ``is_query`` (a condition on ``id``) holds."""
    ship_package(vectors.sparkSession)
    stage = Staged(vectors.sparkSession)
    rows = stage.write(quantised(vectors, id_col, vector_col).distinct(), "topk-vectors")
    widths = {r["w"]: r["n"] for r in rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}
    if not widths:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    centres = pivots(rows, widths)
    placed = stage.write(rows.mapInArrow(_assign(centres), "id long, v array<double>, cell int, far double"), "topk-placed")
    cells = placed.groupBy(F.size("v").alias("w"), "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    radius, parts = ({w: np.zeros(len(p), kind) for w, p in centres.items()} for kind in (float, np.int64))
    for r in cells:
        radius[r["w"]][r["cell"]] = r["far"]
        parts[r["w"]][r["cell"]] = -(-r["n"] // _per(SHARD_BYTES, r["w"]))
    counts = rows.sparkSession.createDataFrame([(w, i, int(n)) for w, p in parts.items() for i, n in enumerate(p.tolist())], "w int, cell int, parts long")
    dealt = placed.withColumn("w", F.size("v")).join(counts, ["w", "cell"])
    dealt = dealt.groupBy("w", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("shard"))
    shards = stage.write(dealt, "topk-shards")
    queries = rows.where(is_query).groupBy("id", F.size("v").alias("w")).agg(F.min("v").alias("v"))
    queries = stage.write(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    found = None
    for first in (True, False):
        if first:
            asked = queries.withColumn("kth", F.lit(float("-inf")))
        else:
            kth = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("have"))
            limit = F.when(F.col("have") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf")))
            asked = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce(limit, F.lit(float("-inf"))).alias("kth"))
        sent = asked.mapInArrow(_sent(centres, radius, parts, first), "id long, v array<double>, kth double, cell int, part int")
        sent = stage.write(sent, "topk-sent")
        keys = ["w", "cell", "part"]
        many = sent.groupBy(F.size("v").alias("w"), "cell", "part").agg(F.count("*").alias("n"))
        blocks = sent.withColumn("w", F.size("v")).join(many, keys)
        per = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("w") + 40)))
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / per).cast("long")).alias("block_no")
        blocks = blocks.groupBy(*keys, block).agg(F.collect_list(F.struct("id", "v", "kth")).alias("block"))
        pairs = blocks.join(shards, keys).select(*keys, "shard", "block")
        now = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
        found = best_k(now if found is None else found.unionByName(now).distinct(), k)
        found = stage.write(found, "topk-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def best_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
