"""Runs: stretches of consecutive words that repeat with a period, and texts with the repeats taken out.

A run is a stretch whose words ``period`` apart are equal (its smallest period), at least ``LEAST_WORDS`` words and
``LEAST_TIMES`` periods long, that no neighbouring word extends. A word goes if it stands in a run behind that run's first period.

Method: Crochemore's partition refinement. Positions are classed by the factor of length l that begins there. Class
members that are neighbours at a distance of exactly l are squares with a primitive root (a factor between them would make the
root a power), and squares of one period at consecutive places are one run. Classes of length l + 1 come from those of length
l: whatever precedes a class that has just been parted is parted likewise, and of the parts of a class all but
the largest are handed on, so a position is looked at log n times. Class members are a segment of one array (for the
smaller half) and a linked list in order of place (for neighbours); the pairs that a change makes neighbours wait in a table for the
length that equals their distance. All of it is numpy over the words of many texts at once, which is cut by text where
batches begin: classes hold places of one text, texts are independent, and there is no shuffle.

Defined results. A null text has no words. Words are parted by the six ASCII white-space characters. Rows that repeat are
rows of their own; a null id stays. A very long text is refined by itself, in memory that is linear in its words. The
collapsed text is the kept words joined by one space, also where there is no run. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_CLASS, ship_package, text_or_empty

#: Words and periods that a run must have.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text that are refined together.
REFINE_BYTES = 4 << 20


class _Waiting:
    """Places by the distance to their next class member, until the length reaches it."""

    def __init__(self):
        self.by: dict[int, list[np.ndarray]] = defaultdict(list)

    def add(self, place: np.ndarray, gap: np.ndarray) -> None:
        if not len(place):
            return
        order = np.argsort(gap, kind="stable")
        gap, place = gap[order], place[order]
        edges = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
        for g, part in zip(gap[edges].tolist(), np.split(place, edges[1:])):
            self.by[g].append(part)

    def take(self, gap: int) -> np.ndarray:
        parts = self.by.pop(gap, None)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _first_classes(codes: np.ndarray):
    """Segments, their members in order of place, and neighbours: classes of one word. A class is named by where its segment begins."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.r_[True, codes[order][1:] != codes[order][:-1]] if n else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, n])
    cls, count = np.empty(n, np.int64), np.zeros(n, np.int64)
    cls[order] = np.repeat(begin, size)
    count[begin] = size
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    after, prior = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    same = np.flatnonzero(~new)
    after[order[same - 1]] = order[same]
    prior[order[same]] = order[same - 1]
    return order, where, cls, count, after, prior


def squares(codes: np.ndarray, reach: np.ndarray):
    """``(length, places)`` of all squares with primitive roots, by length; a place's root may have ``reach`` words at most.

    ``codes`` must hold a code of its own behind every text, and no code in two texts.
    """
    order, where, cls, count, after, prior = _first_classes(codes)
    waiting, seen = _Waiting(), np.zeros(len(codes), bool)

    def wait(place, least):
        gap = after[place] - place
        keep = (after[place] >= 0) & (gap >= least) & (gap <= reach[place])
        waiting.add(place[keep], gap[keep])

    wait(np.arange(len(codes)), 1)
    small = np.arange(len(codes))
    length = 1
    while len(small):
        due = waiting.take(length)
        due = due[after[due] == due + length]
        if len(due):
            yield length, np.unique(due)
        j = small - 1
        j = j[j >= 0]
        j = j[(count[cls[j]] > 1) & (reach[j] > length)]
        small = j[:0]
        if len(j):
            a, b = cls[j], cls[j + 1]
            # Out of the lists: what stands before a chain of leaving members and what stands behind it become neighbours.
            by = np.lexsort((j, a))
            x, ax = j[by], a[by]
            chain = np.r_[True, (ax[1:] != ax[:-1]) | (after[x[:-1]] != x[1:])]
            left, right = prior[x[chain]], after[x[np.r_[chain[1:], True]]]
            after[left[left >= 0]] = right[left >= 0]
            prior[right[right >= 0]] = left[right >= 0]
            joined = left[(left >= 0) & (right >= 0)]
            # New classes: members of one class before members of one class that has been parted.
            by = np.lexsort((j, b, a))
            j, a, b = j[by], a[by], b[by]
            new_a = np.r_[True, a[1:] != a[:-1]]
            new = new_a | np.r_[True, b[1:] != b[:-1]]
            first = np.flatnonzero(new_a)
            leaving = np.diff(np.r_[first, len(j)])
            head = a[first]
            rest = count[head] - leaving
            # They take the end of their class's segment; who stands there goes where they leave.
            tail = np.repeat(head + rest, leaving)
            slot = tail + np.arange(len(j)) - np.repeat(first, leaving)
            seen[j] = True
            there = order[slot]
            there = there[~seen[there]]
            seen[j] = False
            gone = where[j][where[j] < tail]
            order[gone] = there
            where[there] = gone
            order[slot] = j
            where[j] = slot
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(j)])
            cls[j] = np.repeat(slot[begin], size)
            count[head] = rest
            count[slot[begin]] = size
            same = np.flatnonzero(~new)
            after[j], prior[j] = -1, -1
            after[j[same - 1]] = j[same]
            prior[j[same]] = j[same - 1]
            wait(np.concatenate([joined, j[same - 1]]), length + 1)
            # All parts but the largest are handed on.
            owner = np.cumsum(new_a)[begin] - 1
            largest = np.maximum.reduceat(size, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
            ranked = np.lexsort((-size, owner))
            top = ranked[np.r_[True, owner[ranked][1:] != owner[ranked][:-1]]]
            stays = np.zeros(len(size), bool)
            stays[top[largest > rest]] = True
            parted = np.flatnonzero((largest > rest) & (rest > 0))
            # Of a class that left as a whole into one other nothing is handed on: its largest part is all of it.
            if len(parted):
                spread = np.repeat(head[parted], rest[parted]) + np.arange(rest[parted].sum()) - np.repeat(np.cumsum(rest[parted]) - rest[parted], rest[parted])
                small = np.concatenate([j[~np.repeat(stays, size)], order[spread]])
            else:
                small = j[~np.repeat(stays, size)]
        length += 1
    # Nothing is parted any more.
    for length in sorted(waiting.by):
        due = waiting.take(length)
        due = due[after[due] == due + length]
        if len(due):
            yield length, np.unique(due)


def find_runs(codes: np.ndarray, sizes: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of the runs of texts that lie one behind the other, by text, start and period.

    ``codes`` are numbers of words, ``sizes`` the words of each text. ``least_times`` must be 2 or more.
    """
    if least_times < 2:
        raise ValueError("a run has two periods at least")
    codes, sizes = np.asarray(codes, np.int64), np.asarray(sizes, np.int64)
    begin = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= max(least_words, least_times))
    n = sizes[long]
    start = np.cumsum(n + 1) - (n + 1)  # one more place behind every text
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    total = int((n + 1).sum())
    text = np.repeat(np.arange(len(long)), n + 1)
    last = start + n
    words = np.ones(total, bool)
    words[last] = False
    most = int(codes.max()) + 1
    key = np.empty(total, np.int64)
    inside = np.repeat(begin[long] - start, n + 1)[words] + np.flatnonzero(words)
    key[words] = text[words] * (most + 1) + codes[inside]
    key[last] = np.arange(len(long)) * (most + 1) + most
    reach = np.repeat(n // least_times, n + 1)
    found = []
    for period, place in squares(key, reach):
        edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1] + 1])
        low, high = place[edge], place[np.r_[edge[1:], len(place)] - 1]
        length = high - low + 2 * period
        keep = length >= max(least_words, least_times * period)
        found.append(np.stack([low[keep], length[keep], np.full(keep.sum(), period)]))
    low, length, period = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    by = np.lexsort((period, low))
    low, length, period = low[by], length[by], period[by]
    return long[text[low]], low - start[text[low]], length, period


def _runs(least_words: int, least_times: int, id_type: pa.DataType):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("key", id_type), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        texts = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]  # bytes part at ASCII white space only
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        text, start, length, period = find_runs(codes, sizes, least_words, least_times)
        begin = np.cumsum(sizes) - sizes
        # Words behind the first period of a run, by differences.
        step = np.zeros(len(codes) + 1, np.int64)
        np.add.at(step, begin[text] + start + period, 1)
        np.add.at(step, begin[text] + start + length, -1)
        kept = np.cumsum(step[:-1]) == 0
        touched = set(text.tolist())
        collapsed = []
        for i, words in enumerate(texts):
            if i in touched:
                words = [words[k] for k in np.flatnonzero(kept[begin[i] : begin[i] + sizes[i]]).tolist()]
            collapsed.append(b" ".join(words))
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(run_type)))
        return pa.record_batch([b.column(0), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)

    def run(batches):
        for b in batches:
            step = max(1, int(b.num_rows * REFINE_BYTES / max(b.column(1).nbytes, REFINE_BYTES)))
            for i in range(0, b.num_rows, step):
                yield rows(b.slice(i, step))

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """``key, n_words, runs, collapsed``: the runs (start, length and period in words) of every text by start and period, and what is left without repeats."""
    from pyspark.sql.pandas.types import to_arrow_type

    if least_times < 2:
        raise ValueError("a run has two periods at least")
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    kind = source.schema["key"].dataType
    one = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = T.StructType().add("key", kind).add("n_words", "long").add("runs", T.ArrayType(one)).add("collapsed", "string")
    return source.mapInArrow(_runs(least_words, least_times, to_arrow_type(kind)), schema)


def longest_run(runs: Column) -> Column:
    """The longest of an array of runs, of equals the first, then the one of the smallest period; null without runs."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(ranked.isNotNull(), F.struct((-ranked["start"]).alias("start"), ranked["length"].alias("length"), (-ranked["period"]).alias("period")))


def with_cycles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: every tenth text (by a hash of its id) repeats some of its own words in a cycle to its end.

    A test load with known runs. With h the CRC-32 of the id in decimals and g = h div 10, a text with h mod 10 = 0 and n words
    has its word i >= a replaced by its word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id has no hash.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"({WORD_CLASS})"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    a = F.col("g") % n
    rows = rows.withColumn("a", F.when(n > 0, a).cast("int")).withColumn("n", n.cast("int"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("p", p)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), cycle), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))
