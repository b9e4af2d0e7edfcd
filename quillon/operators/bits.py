"""Overlaps of binary rows by bit planes: the inner loop of the exact searches and joins of fingerprints.

A block of references is held as one bitmap a slot, a bit a reference. The bitmaps of a query's slots are added by carry-save
adders, which gives the overlap with every reference as planes of bits, 64 references a machine word; a limit on the overlap is a
few more operations on the planes, and only references that pass it are looked at one by one. For 16 slots that is about one
word operation a reference, where a dense product takes as many multiplications as there are slots in all.

References of one size stand together, in the order of their ids: there the similarity grows with the overlap, so the best
of them are those with the largest overlaps, ties by id. Rows of sizes that few have are counted one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of the bitmaps of a block of references, references of a block and queries of a block at most, and rows of one size that are a group of their own.
BITMAP_BYTES, MOST_REFERENCES, MOST_QUERIES, OWN_GROUP = 16 << 20, 1 << 18, 1 << 16, 512


def pack(ids: np.ndarray, sizes: np.ndarray, slots: np.ndarray, width: int) -> bytes:
    kind = np.uint16 if width <= 1 << 16 else np.uint32
    return b"".join((np.int64(len(ids)).tobytes(), ids.astype(np.int64).tobytes(), sizes.astype(np.uint32).tobytes(), slots.astype(kind).tobytes()))


def unpack(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids, starts, slots`` of packed rows, in the order of their ids; row i has the slots from ``starts[i]`` to ``starts[i + 1]``."""
    kind = np.uint16 if width <= 1 << 16 else np.uint32
    ids, sizes, slots = [], [], []
    for part in parts:
        n = int(np.frombuffer(part, np.int64, 1)[0])
        ids.append(np.frombuffer(part, np.int64, n, 8))
        sizes.append(np.frombuffer(part, np.uint32, n, 8 + 8 * n))
        slots.append(np.frombuffer(part, kind, -1, 8 + 12 * n))
    ids, sizes, slots = np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(slots).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)]
    new = sizes[order]
    ends = np.r_[0, np.cumsum(new)]
    at = np.repeat(starts[:-1][order] - ends[:-1], new) + np.arange(ends[-1])
    return ids[order], ends, slots[at]


def chunks(width: int):
    """Arrow batches ``id, slots, values, no`` to ``no, rows``: the rows of every block number, packed."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, no = b.column(0).to_numpy(), b.column(3).to_numpy()
            if not (b.column(2).flatten().to_numpy(zero_copy_only=False) == 1).all():
                raise ValueError("a binary row holds ones only")
            sizes, slots = b.column(1).value_lengths().to_numpy(), b.column(1).flatten().to_numpy()
            if len(slots) and not 0 <= int(slots.min()) <= int(slots.max()) < width:
                raise ValueError("a slot lies outside the width")
            row = np.argsort(no, kind="stable")
            starts, new = np.r_[0, np.cumsum(sizes)][:-1], sizes[row]
            ends = np.r_[0, np.cumsum(new)]
            slots = slots[np.repeat(starts[row] - ends[:-1], new) + np.arange(ends[-1])]
            cuts = np.flatnonzero(np.diff(no[row], prepend=-1, append=-1))
            out = [pack(ids[row[a:z]], new[a:z], slots[ends[a] : ends[z]], width) for a, z in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([pa.array(no[row][cuts[:-1]]), pa.array(out, pa.binary())], names=["no", "rows"])

    return run


def similarities(metric: str, shared: np.ndarray, na: int, nb: np.ndarray, width: int) -> np.ndarray:
    """Of a row with ``na`` slots and rows with ``nb`` that share ``shared`` with it; 0 where one has none."""
    shared, nb = shared.astype(np.float64), np.asarray(nb, np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "jaccard":
            value = shared / (na + nb - shared)
        elif metric == "cosine":
            value = shared / np.sqrt(na * nb)
        elif metric == "hamming":
            value = 1 - (na + nb - 2 * shared) / width
        else:
            raise ValueError(f"unknown metric {metric}")
    return np.where((na > 0) & (nb > 0), np.clip(value, 0, 1), 0.0)


class Group:
    """References of one size, as a bitmap a slot."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, slots: np.ndarray, rows: np.ndarray, width: int):
        self.ids, self.size = ids[rows], int(starts[rows[0] + 1] - starts[rows[0]])
        self.sizes = np.full(len(rows), self.size)
        words = -(-len(rows) // 64)
        self.bitmaps = np.zeros((width, words), np.uint64)
        step = max(64, (8 << 20) // width // 64 * 64)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            n = starts[some + 1] - starts[some]
            ends = np.r_[0, np.cumsum(n)]
            flat = slots[np.repeat(starts[some] - ends[:-1], n) + np.arange(ends[-1])]
            dense = np.zeros((width, -(-len(some) // 64) * 64), bool)
            dense[flat, np.repeat(np.arange(len(some)), n)] = True
            self.bitmaps[:, at // 64 : at // 64 + dense.shape[1] // 64] = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
        self.every = np.zeros(words, np.uint64)
        self.every[:] = np.packbits(np.arange(words * 64) < len(rows), bitorder="little").view(np.uint64)
        self.guess = 0
        # Sums and carries of the adders: none is written twice for a query.
        self._spare = np.empty((1, words), np.uint64)

    def _add(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Planes of the number of bitmaps that have a bit, from the lowest."""
        most = 2 * len(rows) + 16
        if len(self._spare) < most:
            self._spare = np.empty((most, len(self.every)), np.uint64)
        spare, used, planes = self._spare, 2, []
        x, y = spare[0], spare[1]
        while rows:
            carries, left = [], rows
            at = 0
            while len(left) - at > 1:
                a, b = left[at], left[at + 1]
                if len(left) - at > 2:
                    c = left[at + 2]
                    total, carry = spare[used], spare[used + 1]
                    used += 2
                    np.bitwise_xor(a, b, out=x)
                    np.bitwise_and(a, b, out=y)
                    np.bitwise_and(x, c, out=carry)
                    np.bitwise_or(y, carry, out=carry)
                    np.bitwise_xor(x, c, out=total)
                    at += 3
                else:
                    total, carry = spare[used], spare[used + 1]
                    used += 2
                    np.bitwise_xor(a, b, out=total)
                    np.bitwise_and(a, b, out=carry)
                    at += 2
                carries.append(carry)
                left.append(total)
            planes.append(left[at])
            rows = carries
        return planes

    def overlaps(self, own: np.ndarray, skip: int | None) -> Overlaps:
        return Overlaps(self, self._add([self.bitmaps[s] for s in own]), skip)


class Few:
    """References of any sizes, a byte a slot and row."""

    size = None

    def __init__(self, ids: np.ndarray, starts: np.ndarray, slots: np.ndarray, rows: np.ndarray, width: int):
        self.ids, self.sizes = ids[rows], np.diff(starts)[rows]
        ends = np.r_[0, np.cumsum(self.sizes)]
        self.dense = np.zeros((width, len(rows)), bool)
        self.dense[slots[np.repeat(starts[rows] - ends[:-1], self.sizes) + np.arange(ends[-1])], np.repeat(np.arange(len(rows)), self.sizes)] = True
        self.low, self.high = int(self.sizes.min()), int(self.sizes.max())

    def every(self, own: np.ndarray, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All places, and their overlaps."""
        places, shared = np.arange(len(self.ids)), self.dense[own].sum(0)
        if skip is not None:
            keep = self.ids != skip
            places, shared = places[keep], shared[keep]
        return places, shared


class Overlaps:
    """Overlaps of one query with a group, as planes; ``skip`` is an id that takes no part."""

    def __init__(self, group: Group, planes: list[np.ndarray], skip: int | None):
        self.group, self.planes, self.skip = group, planes, -1
        if skip is not None:
            at = int(np.searchsorted(group.ids, skip))
            if at < len(group.ids) and group.ids[at] == skip:
                self.skip = at

    def least(self, t: int) -> np.ndarray:
        """The bitmap of references with ``t`` slots in common or more."""
        if t <= 0:
            out = self.group.every.copy()
        elif t >= 1 << len(self.planes):
            return np.zeros_like(self.group.every)
        else:
            # From the lowest bit: a plane that has to be set, or may be set instead of all below it.
            out = None
            for i, plane in enumerate(self.planes):
                if t >> i & 1:
                    out = plane.copy() if out is None else np.bitwise_and(plane, out, out=out)
                elif out is not None:
                    np.bitwise_or(plane, out, out=out)
        if self.skip >= 0:
            out[self.skip >> 6] &= ~np.uint64(1 << (self.skip & 63))
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """Overlaps with the references at the given places."""
        out, word, bit = np.zeros(len(places), np.int64), places >> 6, (places & 63).astype(np.uint64)
        for i, plane in enumerate(self.planes):
            out += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << i
        return out

    def best(self, k: int, least: int) -> np.ndarray:
        """Places of the k references with the largest overlaps of ``least`` or more, of equal ones the first."""
        most = (1 << len(self.planes)) - 1
        t = max(min(self.group.guess, most), least)
        found = self.least(t)
        n = int(np.bitwise_count(found).sum())
        above, more = None, 0
        while n >= k and t <= most:
            above = self.least(t + 1)
            more = int(np.bitwise_count(above).sum())
            if more < k:
                break
            t, found, n = t + 1, above, more
        while n < k and t > least:
            above, more = found, n
            t -= 1
            found = self.least(t)
            n = int(np.bitwise_count(found).sum())
        self.group.guess = t
        if n <= k:
            return places_of(found)
        if above is None or not more:
            return places_of(found, k)
        return np.r_[places_of(above), places_of(found & ~above, k - more)]


def places_of(bitmap: np.ndarray, first: int | None = None) -> np.ndarray:
    """Where a bitmap has bits, in order; only the first of them."""
    words = np.flatnonzero(bitmap)
    if first is not None and len(words) > first:
        words = words[:first]
    row, bit = np.nonzero(np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64))
    return (words[row] * 64 + bit)[:first]


def groups(ids: np.ndarray, starts: np.ndarray, slots: np.ndarray, width: int) -> list[Group | Few]:
    sizes = np.diff(starts)
    uses = np.bincount(sizes)
    own = [np.flatnonzero(sizes == s) for s in np.flatnonzero(uses >= OWN_GROUP)]
    rest = np.flatnonzero(uses[sizes] < OWN_GROUP)
    return [*(Group(ids, starts, slots, rows, width) for rows in own), *([Few(ids, starts, slots, rest, width)] if len(rest) else [])]


def block_references(width: int) -> int:
    """References whose bitmaps are held at a time."""
    return max(64, min(MOST_REFERENCES, 8 * BITMAP_BYTES // width // 64 * 64))


def needed(metric: str, na: int, nb: int, width: int, least: float) -> int:
    """The least overlap of rows of ``na`` and ``nb`` slots whose similarity reaches ``least``; one more than any where none does."""
    reach = np.flatnonzero(similarities(metric, np.arange(min(na, nb) + 1), na, np.full(min(na, nb) + 1, nb), width) >= least)
    return int(reach[0]) if len(reach) else min(na, nb) + 1


def nearest(query: tuple, references: tuple, k: int, metric: str, width: int, skip_self: bool) -> pa.RecordBatch:
    """``query, ref, similarity``: of every query the k best references, equal ones by id."""
    qids, starts, slots = query
    found = groups(*references, width)
    need = lru_cache(maxsize=100_000)(lambda na, nb, least: needed(metric, na, nb, width, least))
    out_q, out_r, out_s = [], [], []
    for i, key in enumerate(qids):
        own = slots[starts[i] : starts[i + 1]]
        na, skip = len(own), int(key) if skip_self else None
        refs, sims = np.zeros(0, np.int64), np.zeros(0)
        for g in found:
            # What can't reach the k-th similarity so far takes no part; what equals it may have a lower id.
            least = need(na, g.size, float(sims[-1])) if g.size is not None and len(sims) == k else 0
            if g.size is not None and least > min(na, g.size):
                continue
            if g.size is None:
                places, shared = g.every(own, skip)
            else:
                o = g.overlaps(own, skip)
                places = o.best(k, least)
                shared = o.at(places)
            s = similarities(metric, shared, na, g.sizes[places], width)
            r = g.ids[places]
            if len(refs):
                r, s = np.r_[refs, r], np.r_[sims, s]
            order = np.lexsort((r, -s))[:k]
            refs, sims = r[order], s[order]
        out_q.append(np.full(len(refs), key))
        out_r.append(refs)
        out_s.append(sims)
    return _batch(out_q, out_r, out_s)


def _batch(q: list, r: list, s: list, names: tuple[str, ...] = ("query", "ref", "similarity")) -> pa.RecordBatch:
    one = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
    return pa.record_batch([one(q, np.int64), one(r, np.int64), one(s, np.float64)], names=list(names))


#: Pairs handed on at a time.
PAIR_ROWS = 50_000


def above(query: tuple, references: tuple, metric: str, width: int, least: float):
    """Batches ``query, ref, similarity`` of the pairs at or above a positive similarity."""
    qids, starts, slots = query
    found = groups(*references, width)
    need = lru_cache(maxsize=100_000)(lambda na, nb: needed(metric, na, nb, width, least))
    out_q, out_r, out_s, n = [], [], [], 0
    for i, key in enumerate(qids):
        own = slots[starts[i] : starts[i + 1]]
        na = len(own)
        for g in found:
            if g.size is not None and need(na, g.size) > min(na, g.size):
                continue
            if g.size is None:
                places, shared = g.every(own, None)
            else:
                o = g.overlaps(own, None)
                places = places_of(o.least(need(na, g.size)))
                shared = o.at(places)
            s = similarities(metric, shared, na, g.sizes[places], width)
            keep = s >= least
            out_q.append(np.full(int(keep.sum()), key))
            out_r.append(g.ids[places[keep]])
            out_s.append(s[keep])
            n += len(out_q[-1])
        if n > PAIR_ROWS:
            yield _batch(out_q, out_r, out_s)
            out_q, out_r, out_s, n = [], [], [], 0
    yield _batch(out_q, out_r, out_s)


def linked(query: tuple, references: tuple, width: int, percent: int, same: bool):
    """Batches ``early, late, shared, union`` of the pairs of a block with another (or, if ``same``, with itself) whose sets reach a Jaccard of ``percent`` hundredths."""
    qids, starts, slots = query
    found = groups(*references, width)
    out, n = [], 0

    def batch():
        rows = np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64)
        return pa.record_batch([pa.array(c) for c in rows], names=["early", "late", "shared", "union"])

    for i, key in enumerate(qids):
        own = slots[starts[i] : starts[i + 1]]
        na = len(own)
        if not na:
            continue
        for g in found:
            # 100 * x >= percent * (na + nb - x)
            if g.size is None:
                if 100 * g.high < percent * na or 100 * na < percent * g.low:
                    continue
                places, shared = g.every(own, None)
            else:
                need = -(-percent * (na + g.size) // (100 + percent))
                if need > min(na, g.size):
                    continue
                o = g.overlaps(own, None)
                places = places_of(o.least(need))
                shared = o.at(places)
            if same:
                later = g.ids[places] > key
                places, shared = places[later], shared[later]
            if not len(places):
                continue
            ref = g.ids[places]
            union = na + g.sizes[places] - shared
            keep = (100 * shared >= percent * union) & (union > 0)
            shared, union, ref = shared[keep], union[keep], ref[keep]
            out.append(np.stack([np.minimum(ref, key), np.maximum(ref, key), shared, union]).astype(np.int64))
            n += len(ref)
        if n > PAIR_ROWS:
            yield batch()
            out, n = [], 0
    yield batch()
