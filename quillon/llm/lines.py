"""Substring dedup by unit hashing: repeated lines or sentences go, the earliest occurrence stays.

A text is cut into units: its paragraphs (lines with no blank one between), its lines, and (by default) the
sentences of a line, so that a passage pasted into a line is found too. A unit is normalised (lower case, white
space collapsed, ends trimmed) and hashed to 128 bits. Units of fewer than ``LEAST_WORDS`` words are left alone:
a short sentence goes with its line and a short line with its paragraph, not by itself. Of equal units the one with the smallest
(id, offset) stays; the others are removed, with their offsets in the original text (code points).

Plan. Texts are read in one task pass that emits a small row per unit. Digests are counted by a key
aggregation with map-side combination, so a line that stands in a third of all documents is one partial row a
task; only digests with more than one occurrence are joined back, by a plain equi-join that adaptive
execution splits where a digest is hot.

Defined results. A null text has no units. A null id ranks after all others. Rows that
repeat an id are taken as one document: equal units at equal offsets are the same occurrence. Line ends are LF, CR LF or CR and belong
to no unit but a paragraph, for those inside it. A line that is one sentence, or a paragraph of one line, is one unit. A very long text is one row of a task, a long
line one unit. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, text_or_empty

#: Words that a unit must have to be removed.
LEAST_WORDS = 8
LINE = re.compile(r"[^\r\n]+")
#: A sentence with its closing marks; what stands behind the last mark is one too.
SENTENCE = re.compile(r"[^\r\n.!?]*(?:[.!?]+(?![\s\"')\]])[^\r\n.!?]*)*(?:[.!?]+[\"')\]]*|(?=[\r\n])|\Z)")
LINE_ENDS = ("\n", "\r\n", "\r")
#: Rows in a batch handed on.
ROWS = 50_000


def units(text: str, sentences: bool = True, least_words: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units that may be removed; the span has no white space at its ends."""
    out = []
    for m in (SENTENCE if sentences else LINE).finditer(text):
        raw = m[0]
        words = raw.lower().split()
        if len(words) >= least_words:
            lead = len(raw) - len(raw.lstrip())
            start = m.start() + lead
            out.append((start, start + len(raw.strip()), xxhash.xxh3_128_digest(" ".join(words).encode())))
    return out


def blocks(text: str, least_words: int = LEAST_WORDS, known: Iterable[tuple] = ()) -> list[tuple[int, int, bytes]]:
    """As ``units``, of whole lines and paragraphs; spans of ``known`` units are left out."""
    spans, paragraph = [], None
    for m in LINE.finditer(text):
        raw = m[0]
        if not (body := raw.strip()):
            paragraph = None
            continue
        start = m.start() + len(raw) - len(raw.lstrip())
        spans.append((start, start + len(body)))
        if paragraph is not None and text[after : m.start()] in LINE_ENDS:
            paragraph[1] = start + len(body)
        else:
            paragraph = [start, start + len(body)]
            spans.append(paragraph)
        after = m.end()
    out = []
    for start, end in sorted({tuple(s) for s in spans} - {(a, b) for a, b, _ in known}):
        words = text[start:end].lower().split()
        if len(words) >= least_words:
            out.append((start, end, xxhash.xxh3_128_digest(" ".join(words).encode())))
    return out


def _emit(sentences: bool, least: int, id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = units(text, sentences, least)
                held += [(key, *u) for u in found + blocks(text, least, found)]
                if len(held) > ROWS:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                    held = []
        if held:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per removed unit: ``key, start, end, first_key, first_start, copies`` (occurrences of the unit)."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    kind = source.schema["key"].dataType
    schema = T.StructType().add("key", kind).add("start", "long").add("end", "long").add("digest", "binary")
    rows = source.mapInArrow(_emit(sentences, least_words, to_arrow_type(kind)), schema)
    # Nulls rank last: the flag is compared before the id.
    rank = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("start").alias("start"))
    found = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min(rank).alias("first")).where("copies > 1")
    found = found.select("digest", "copies", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"))
    again = ~(F.col("key").eqNullSafe(F.col("first_key")) & (F.col("start") == F.col("first_start")))
    return rows.join(found, "digest").where(again).select("key", "start", "end", "first_key", "first_start", "copies")


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def remove_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of their texts.

    Spans name their text by its id alone, so rows that repeat an id (or have none, more than one of them) are an error: the
    spans of one text would cut another.
    """
    if not docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("ids must be unique where units are cut out")
    spans = removed.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    joined = docs.join(spans.withColumnRenamed("key", "__key"), F.col(id_col).eqNullSafe(F.col("__key")), "left").drop("__key")
    names = list(docs.columns)
    at, last = names.index(text_col), len(names)

    def run(batches):
        for b in batches:
            texts = [t if t is None or not s else _cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(b.column(at).to_pylist(), b.column(last).to_pylist())]
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(last)], names=names)

    return joined.mapInArrow(run, docs.schema)
