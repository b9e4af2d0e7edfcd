"""Fill-in-middle: a text is cut into prefix, middle and suffix, and written in another order between marks.

Cuts fall between units (lines by default). A document's four draws are the first four 8-digit groups of the hex
SHA-256 of ``seed:id``: the first two choose the cuts, the third whether the text is transformed at all (``rate`` per
cent), the fourth the order (``spm`` per cent: suffix, prefix, middle; else prefix, suffix, middle). A text that holds
one of the marks stays plain, so that what is written can always be taken apart again (``restore``).

Method. One numpy kernel for a whole Arrow batch, over the UTF-8 buffer of its texts: a table gives each byte its class,
a second table says for two neighbouring classes whether a unit begins at the latter, the running sum of these
beginnings (less its value before the document) numbers the units, and one ``searchsorted`` finds the cuts of all rows.
Rows stay where they are: there is no shuffle.

Defined results. A null text counts as empty; an empty text is plain with n = 0. A null id is hashed as ``null``.
Rows that repeat are rows of their own with equal results where ids are equal. A very long text is a batch of its own. A
part may be empty. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, ship_package, text_or_empty

#: Prefix, suffix and middle mark.
MARKS = ("<P>", "<S>", "<M>")
#: Classes of bytes: those inside a character, line feeds, other white space, the rest.
INSIDE, FEED, SPACE, OTHER = range(4)
#: Bytes of text that the kernel takes at a time.
KERNEL_BYTES = 4 << 20


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = INSIDE
    table[list(ASCII_SPACE)] = SPACE
    table[ord("\n")] = FEED
    return table


CLASS = _classes()


def _begins(unit: str) -> np.ndarray:
    """Whether a unit begins at a byte, by the class of the byte before and its own."""
    out = np.zeros((4, 4), bool)
    if unit == "line":
        out[FEED, :] = True
    elif unit == "word":  # a word with the white space behind it; white space in front of the first is one too
        out[np.ix_([FEED, SPACE], [INSIDE, OTHER])] = True
    elif unit == "character":
        out[:, [FEED, SPACE, OTHER]] = True
    else:
        raise ValueError(f"unknown unit {unit}")
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends) in them; texts must not be null."""
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def marked(data: np.ndarray, at: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """Whether a text holds one of the marks."""
    out = np.zeros(len(at) - 1, bool)
    for mark in marks:
        raw = mark.encode()
        if len(data) < len(raw):
            continue
        places = np.flatnonzero(data[: len(data) - len(raw) + 1] == raw[0])
        for k in range(1, len(raw)):
            places = places[data[places + k] == raw[k]]
        row = np.searchsorted(at, places, "right") - 1
        out[row[places + len(raw) <= at[row + 1]]] = True
    return out


def cuts(data: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, unit: str = "line"):
    """Of every text: its units, the places of both cuts, and the characters before the first and between them."""
    kind = CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = _begins(unit)[kind[:-1], kind[1:]]
    filled = at[:-1] < at[1:]
    # What stands before a document is of another one: its first byte begins a unit whatever came before.
    begins[at[:-1][filled]] = True
    number = np.r_[0, np.cumsum(begins, dtype=np.int64)]
    before = number[at[:-1]]
    n = number[at[1:]] - before
    first, second = (np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1)))
    # The unit after u others begins at the byte where the sum first reaches u + 1; after the last stands the text's end.
    a, b = (np.where(u < n, np.searchsorted(number, before + u + 1) - 1, at[1:]) for u in (first, second))
    letters = np.r_[0, np.cumsum(kind != INSIDE, dtype=np.int64)]
    return n, a, b, letters[a] - letters[at[:-1]], letters[b] - letters[a]


def _kernel(unit: str, rate: int, spm: int, marks: tuple[str, str, str], id_type: pa.DataType):
    raw = [np.frombuffer(m.encode(), np.uint8) for m in marks]
    schema = pa.schema([("key", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = buffers(b.column(1))
        h = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
        n, one, two, before, between = cuts(data, at, h[0], h[1], unit)
        plain = (at[:-1] == at[1:]) | marked(data, at, marks) | (h[2] % 100 >= rate)
        late = h[3] % 100 < spm
        pieces: list[np.ndarray] = []
        for start, x, y, end, same, suffix_first in zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist(), plain.tolist(), late.tolist()):
            if same:
                pieces.append(data[start:end])
            elif suffix_first:
                pieces += [raw[1], data[y:end], raw[0], data[start:x], raw[2], data[x:y]]
            else:
                pieces += [raw[0], data[start:x], raw[1], data[y:end], raw[2], data[x:y]]
        size = np.diff(at) + np.where(plain, 0, sum(map(len, raw)))
        ends = np.r_[0, np.cumsum(size)].astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(pieces) if pieces else b"")])
        form = np.where(plain, "plain", np.where(late, "spm", "psm"))
        return pa.record_batch([b.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(before, mask=plain), pa.array(between, mask=plain), text], schema=schema)

    def run(batches):
        for b in batches:
            step = max(1, int(b.num_rows * KERNEL_BYTES / max(b.column(1).nbytes, KERNEL_BYTES)))
            for i in range(0, b.num_rows, step):
                out = rows(b.slice(i, step))
                yield pa.record_batch([*out.columns[:-1], out.column(5).cast(pa.string())], names=schema.names)

    return run


def transform(
    docs: DataFrame, seed: int | str, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output``: units, ``plain``, ``psm`` or ``spm``, code points of the parts (null if plain), the text."""
    from pyspark.sql.pandas.types import to_arrow_type

    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are per cent")
    # A mark that begins as another ends could come out of a text and the mark beside it.
    if len(set(marks)) != 3 or not all(marks) or any(a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) for a in marks for b in marks):
        raise ValueError("three marks are needed, none within another and none that begins as one ends")
    _begins(unit)
    ship_package(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), digest.alias("digest"))
    draws = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    source = source.select("key", "text", *draws)
    kind = source.schema["key"].dataType
    schema = T.StructType().add("key", kind).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return source.mapInArrow(_kernel(unit, rate, spm, marks, to_arrow_type(kind)), schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    p, s, m = marks
    between = lambda x, mark, end: F.substring_index(F.substring_index(x, mark, -1), end, 1) if end else F.substring_index(x, mark, -1)
    psm = F.concat(between(output, p, s), between(output, m, None), between(output, s, m))
    spm = F.concat(between(output, p, m), between(output, m, None), between(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
