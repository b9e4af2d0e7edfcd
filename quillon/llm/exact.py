"""Exact dedup by Grace hash: partition to spill files until each bucket fits an open-addressing table.

Two texts are equal when they are identical after ASCII white space is deleted; complete contents
are compared, a hash only finds the slot. Of equal texts the row with the most code points in its
original text stays, then the one with the smallest id.

Plan. Each input partition combines its own copies in a table first, so one hot content reaches the
shuffle at most once a partition. The shuffle by content hash is the first level of Grace
partitioning; a task whose distinct contents outgrow its memory bound writes them to spill files by
further hash bits and takes each file in turn, again by recursion. The per-content decisions are
small and are joined to the rows' digests by a plain equi-join, which adaptive execution splits
where one content holds a large part of the rows. Recursion ends after twelve levels (48 bits of the hash): contents
that agree so far are one table, whatever its size.

Defined results. A null text counts as empty; all empty texts are equal. Null ids rank after all
others. Rows that repeat both id and text are copies of each other and all carry ``kept`` where their
id is the one that stays. A very long text is one entry. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, ship_package, text_or_empty

#: Bytes of distinct contents a task's table holds before it spills.
TABLE_BYTES = 48 << 20
#: Spill files a level makes; each level takes further bits of the hash.
FANOUT = 16
#: Rows are handed on in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def _rank(cp: int, key) -> tuple:
    """Smaller ranks stay: most code points, then smallest id, nulls last."""
    return (-cp, key is None, key if key is not None else 0)


def _first(a: tuple, b: tuple) -> bool:
    """Whether (code points, id or row) ``a`` stays rather than ``b``."""
    if isinstance(a[1], _Row):
        return a[0] > b[0] or a[0] == b[0] and a[1] < b[1]
    return _rank(*a) < _rank(*b)


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content is equal."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.rows: list[list] = []  # [code points, id, count]
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 2, -1, np.int64)
        mask = len(self.slots) - 1
        for at, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = at

    def add(self, h: int, content: bytes, cp: int, key, count: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (at := slots[i]) >= 0:
            if self.hashes[at] == h and self.contents[at] == content:
                row = self.rows[at]
                row[2] += count
                if _first((cp, key), (row[0], row[1])):
                    row[0], row[1] = cp, key
                return
            i = (i + 1) & mask
        slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.rows.append([cp, key, count])
        # A row holds its text once more.
        self.bytes += len(content) * (3 if isinstance(key, _Row) else 1) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()

    def entries(self) -> Iterator[tuple]:
        for h, content, (cp, key, count) in zip(self.hashes, self.contents, self.rows):
            yield h, content, cp, key, count


def grace(entries: Iterator[tuple], level: int = 0, limit: int = TABLE_BYTES, fanout: int = FANOUT) -> Iterator[tuple]:
    """Combine (hash, content, code points, id, count) entries by content, in bounded memory."""
    table = ContentTable()
    for entry in entries:
        table.add(*entry)
        if table.bytes > limit and len(table.hashes) > 1 and level < 12:
            break
    else:
        yield from table.entries()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(f"{folder}/{i}", "w+b") for i in range(fanout)]  # noqa: SIM115
        shift = 60 - 4 * level

        def spill(source):
            for e in source:
                pickle.dump(e, files[(e[0] >> shift) % fanout], protocol=5)

        spill(table.entries())
        del table
        spill(entries)
        for f in files:
            f.seek(0)
            yield from grace(_read(f), level + 1, limit, fanout)
            f.close()


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _normal(batch: pa.RecordBatch, at: int) -> tuple[list[bytes], list[int]]:
    col = batch.column(at)
    cps = pc.utf8_length(col).to_pylist()
    return [x.translate(None, ASCII_SPACE) for x in col.cast(pa.large_binary()).to_pylist()], cps


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _local_combine(limit: int, fanout: int, id_type: pa.DataType):
    schema = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("cp", pa.int64()), ("key", id_type), ("n", pa.int64())])

    def run(batches):
        def entries():
            for b in batches:
                texts, cps = _normal(b, 1)
                for key, text, cp in zip(b.column(0).to_pylist(), texts, cps):
                    yield xxhash.xxh3_64_intdigest(text), text, cp, key, 1

        yield from _batches(((_signed(h), c, cp, key, n) for h, c, cp, key, n in grace(entries(), 0, limit, fanout)), schema)

    return run


def _merge(limit: int, fanout: int, id_type: pa.DataType):
    schema = pa.schema([("digest", pa.binary()), ("keep_key", id_type), ("group_size", pa.int64())])

    def run(batches):
        def entries():
            for b in batches:
                for h, c, cp, key, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                    yield h & 0xFFFFFFFFFFFFFFFF, c, cp, key, n

        yield from _batches(((hashlib.sha256(c).digest(), key, n) for _, c, cp, key, n in grace(entries(), 0, limit, fanout)), schema)

    return run


def _digests(id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            texts, _ = _normal(b, 1)
            yield pa.record_batch([b.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], schema=schema)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: ``key, keep_key, group_size, kept, digest`` (SHA-256 of the normalised text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("content"))
    id_type = source.schema["key"].dataType
    arrow_id = to_arrow_type(id_type)
    partial = T.StructType().add("h", "long").add("content", "binary").add("cp", "long").add("key", id_type).add("n", "long")
    merged = T.StructType().add("digest", "binary").add("keep_key", id_type).add("group_size", "long")
    groups = (
        source.mapInArrow(_local_combine(table_bytes, fanout, arrow_id), partial)
        .repartition(F.col("h"))
        .mapInArrow(_merge(table_bytes, fanout, arrow_id), merged)
    )
    rows = source.mapInArrow(_digests(arrow_id), T.StructType().add("key", id_type).add("digest", "binary"))
    return rows.join(groups, "digest").select("key", "keep_key", "group_size", F.col("key").eqNullSafe(F.col("keep_key")).alias("kept"), "digest")


class _Row:
    """A whole row in a table's place for an id: its rank is that of its id, then of its text."""

    __slots__ = ("key", "text", "values")

    def __init__(self, key, text: str | None, values: dict):
        self.key, self.text, self.values = key, text, values

    def rank(self) -> tuple:
        return (self.key is None, self.key if self.key is not None else 0, self.text or "")

    def __lt__(self, other: "_Row") -> bool:
        return self.rank() < other.rank()

    def __reduce__(self):
        return _Row, (self.key, self.text, self.values)


def _row_entries(batches, at: int, id_at: int, text_at: int):
    """Entries of whole rows: the struct in column ``at`` holds them, with the id and text at these fields."""
    for b in batches:
        rows = b.column(at)
        text = pc.struct_field(rows, [text_at]).cast(pa.string()).fill_null("")
        cps = pc.utf8_length(text).to_pylist()
        ids, raw = pc.struct_field(rows, [id_at]).to_pylist(), text.cast(pa.large_binary()).to_pylist()
        for key, t, cp, values in zip(ids, raw, cps, rows.to_pylist()):
            content = t.translate(None, ASCII_SPACE)
            yield xxhash.xxh3_64_intdigest(content), content, cp, _Row(key, t.decode(), values), 1


def _keep_rows(limit: int, fanout: int, row_type: pa.DataType, id_at: int, text_at: int, last: bool):
    """The rows that stay of a partition's equal texts: with their hash for the shuffle, or at ``last`` as they are."""

    def run(batches):
        held, size = [], 0

        def out():
            rows = pa.array([r.values for _, r in held], row_type)
            if last:
                return pa.RecordBatch.from_struct_array(rows)
            return pa.record_batch([pa.array([_signed(h) for h, _ in held], pa.int64()), rows], names=["h", "row"])

        for h, content, _, row, _ in grace(_row_entries(batches, 1 if last else 0, id_at, text_at), 0, limit, fanout):
            held.append((h, row))
            size += len(content) + 200
            if size > BATCH_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The documents that stay, with all their columns; one row where rows repeat id and text.

    Whole rows go through the same tables as in :func:`exact_groups`, in a partition and then by content hash, so each
    text is shuffled once, and copies of a partition not at all. Of equal rows (length, id) the one with the least text stays.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(docs.sparkSession)
    names = list(docs.columns)
    if len(set(names)) < len(names):
        raise ValueError("column names must differ")
    at = (names.index(id_col), names.index(text_col))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    row = source.schema["row"].dataType
    make = lambda last: _keep_rows(table_bytes, fanout, to_arrow_type(row), *at, last)
    partial = source.mapInArrow(make(False), T.StructType().add("h", "long").add("row", row))
    return partial.repartition(F.col("h")).mapInArrow(make(True), docs.schema)
