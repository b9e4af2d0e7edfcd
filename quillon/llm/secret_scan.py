"""Secrets in texts, also where they are encoded in layers: URL, Unicode, base64 and compressed, nested in any order.

Three kinds are looked for: ``assign`` (a value given to a name such as ``password``), ``access`` (access key ids) and ``hex``
(long runs of hexadecimal digits). A span is a whole match, in code points of the original text, its end exclusive.

Method: a worklist of layers. The text is the first. Each layer is scanned, and what it wraps comes onto the list:

- the layer with all its URL escapes (``%41``), Unicode escapes (``\\u0041``, ``\\x41``, ``&#65;``, ``&quot;``), full-width letters and
  zero-width characters decoded at once, so that what stands around an escape is still around it;
- what a base64 run (also with URL letters, without padding, or wrapped in lines) holds at each of its four alignments: all
  of it where that is UTF-8 or printable UTF-16, else its stretches of ASCII, and of ASCII in UTF-16;
- what a gzip, zlib, bzip2, xz or zstandard stream within such bytes expands to, in pieces of bounded size that end with a line.

A layer keeps, for each of its characters, where they came from in the layer before, and a match goes back through
all of them; in what was compressed it is the whole stream. The list ends when no layer wraps another (the fixpoint). A
layer whose content has been met at the same place of the text is not taken again, so a stream that expands to itself
ends too. Rows stay where they are: there is no shuffle.

Bounds. A text's layers together may hold ``MOST_DECODED`` bytes beyond the text (against streams that expand without end);
where that is reached, ``complete`` is false. Stretches of ASCII or UTF-16 in other bytes count from ``LEAST_TEXT`` characters on, and
base64 from ``LEAST_RUN``: no secret is shorter.

Defined results. A null text counts as empty: no spans. Rows that repeat are rows of their own; a null id stays. Of several layers
that give one span of one kind, the first counts. A very long text is scanned whole. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import binascii
import bz2
import html.entities
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, text_or_empty

#: The kinds in their order, and what each must match; then the least length that counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, LEAST_ACCESS = re.compile(r"AKIA[A-Z0-9]+"), 20
LEAST_VALUE, LEAST_HEX = 6, 24
#: Whole runs of at least that many digits; a shorter run is no match, and nothing of a longer one is.
HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")

#: Bytes that all layers of a text may hold, of a piece of what was compressed, of a text stretch and of a base64 run.
MOST_DECODED, PIECE, LEAST_TEXT, LEAST_RUN = 256 << 20, 4 << 20, 12, 16

ESCAPES = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<byte>(?:\\x[0-9A-Fa-f]{2})+)|(?P<unit>(?:\\u[0-9A-Fa-f]{4})+)|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\U(?P<wide>[0-9A-Fa-f]{8})"
    r"|&#[xX](?P<hex>[0-9A-Fa-f]{1,6});|&#(?P<dec>[0-9]{1,7});|&(?P<name>[A-Za-z][A-Za-z0-9]{1,30};)|(?P<wide_letter>[\uff01-\uff5e])|(?P<nothing>[\u200b-\u200d\u2060\ufeff\u00ad])"
)
ODD = re.compile("[\uff01-\uff5e\u200b-\u200d\u2060\ufeff\u00ad]")
RUN = re.compile(rf"(?:[A-Za-z0-9+/]{{60,76}}\r?\n)+[A-Za-z0-9+/]{{1,76}}|[A-Za-z0-9+/_-]{{{LEAST_RUN},}}")
URL_LETTERS = str.maketrans("-_", "+/", "\r\n")
ASCII_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % LEAST_TEXT)
UTF16_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}" % LEAST_TEXT)
#: First bytes of gzip, zlib, bzip2, xz and zstandard streams. Fixed values.
STREAMS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Of bytes written as URL escapes, all up to white space or quotes belong together: letters and digits are not escaped.
URL_BYTES = re.compile(r"[^\s\"'<>&;,]*%[0-9A-Fa-f]{2}[^\s\"'<>&;,]*")

Locate = Callable[[int, int], tuple[int, int]]


class Layer:
    """A text, the layer it was unwrapped from, and where its stretches stand there."""

    __slots__ = ("text", "parent", "locate", "depth")

    def __init__(self, text: str, parent: Layer | None = None, locate: Locate | None = None):
        self.text, self.parent, self.locate = text, parent, locate
        self.depth = parent.depth + 1 if parent else 0

    def root(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters from a to b come from in the original text."""
        at = self
        while at.parent is not None:
            a, b = at.locate(a, b)
            at = at.parent
        return a, b


class Raw:
    """Bytes that a layer wraps, before it is known what they hold."""

    __slots__ = ("data", "parent", "locate")

    def __init__(self, data: bytes, parent: Layer, locate: Locate):
        self.data, self.parent, self.locate = data, parent, locate

    def root(self) -> tuple[int, int]:
        return self.parent.root(*self.locate(0, len(self.data)))


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the secrets that stand in the text itself."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _characters(raw: bytes) -> list[tuple[str, int]]:
    """The characters of UTF-8 bytes and how many bytes each takes; a byte that is not UTF-8 comes as an empty string."""
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            out.append((raw[at : at + size].decode(), size) if size else ("", 1))
        except UnicodeDecodeError:
            out.append(("", 1))
        at += out[-1][1]
    return out


def _letter(code: int) -> str:
    """The character of a code point, or nothing where there is none."""
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""


def _decoded(m: re.Match) -> list[tuple[str, int, int]]:
    """(character, from, to) of an escape; what can't be decoded is left out."""
    kind, a = m.lastgroup, m.start()
    if kind in ("url", "byte"):
        step = 3 if kind == "url" else 4
        raw, out, at = bytes.fromhex(m[0].replace("%", "").replace("\\x", "")), [], a
        for c, size in _characters(raw):
            if c:
                out.append((c, at, at + step * size))
            at += step * size
        return out
    if kind == "unit":
        units, out, k = [int(x, 16) for x in m[0].split("\\u")[1:]], [], 0
        while k < len(units):
            pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
            c = chr(0x10000 + ((units[k] - 0xD800) << 10) + units[k + 1] - 0xDC00) if pair else _letter(units[k])
            if c:
                out.append((c, a + 6 * k, a + 6 * (k + 1 + pair)))
            k += 1 + pair
        return out
    if kind == "nothing":
        return [("", a, m.end())]
    if kind == "wide_letter":
        return [(chr(ord(m[0]) - 0xFEE0), a, m.end())]
    if kind == "name":
        c = html.entities.html5.get(m["name"], "")
    else:
        c = _letter(int(m[kind], 10 if kind == "dec" else 16))
    return [(c, a, m.end())] if c else []


def _may_hold_escapes(text: str) -> bool:
    return "%" in text or "\\" in text or "&" in text or (not text.isascii() and ODD.search(text) is not None)


def unescaped(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded, or None if there are none."""
    text = layer.text
    if not _may_hold_escapes(text):
        return None
    # Pieces of the new text: where each begins, where it comes from, and whether it was taken over letter by letter.
    begin, source, out, at, size = [], [], [], 0, 0

    def put(piece: str, a: int, b: int, same: bool) -> None:
        nonlocal size
        if piece:
            begin.append(size)
            source.append((a, b, same))
            out.append(piece)
            size += len(piece)

    found = False
    for m in ESCAPES.finditer(text):
        for c, a, b in _decoded(m):
            found = True
            put(text[at:a], at, a, True)
            put(c, a, b, False)
            at = b
    if not found:
        return None
    put(text[at:], at, len(text), True)

    def locate(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(begin, a) - 1, bisect_right(begin, b - 1) - 1
        (x, _, one), (y, z, two) = source[i], source[j]
        return (x + a - begin[i] if one else x), (y + b - begin[j] if two else z)

    return Layer("".join(out), layer, locate)


def _expanded(data: bytes, at: int) -> Iterator[tuple[bytes, bool]]:
    """Pieces of what the stream at a place of the bytes expands to, as far as it is sound."""
    head = data[at : at + 4]
    if head[:2] == b"\x1f\x8b":
        tool = zlib.decompressobj(31)
    elif head[:1] == b"\x78":
        tool = zlib.decompressobj()
    elif head[:3] == b"BZh":
        tool = bz2.BZ2Decompressor()
    elif head[:1] == b"\xfd":
        tool = lzma.LZMADecompressor()
    else:
        tool = None
    try:
        if tool is None:
            with zstandard.ZstdDecompressor().stream_reader(memoryview(data)[at:]) as reader:
                while piece := reader.read(PIECE):
                    yield piece
            return
        piece = tool.decompress(memoryview(data)[at:], PIECE)
        while piece:
            yield piece
            if tool.eof:
                return
            piece = tool.decompress(tool.unconsumed_tail if hasattr(tool, "unconsumed_tail") else b"", PIECE)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


def expansions(data: bytes, at: int) -> Iterator[bytes]:
    """The same in pieces that end with a line, where there are lines."""
    held = b""
    for piece in _expanded(data, at):
        held += piece
        cut = held.rfind(b"\n") + 1
        if len(held) >= PIECE and cut:
            yield held[:cut]
            held = held[cut:]
    if held:
        yield held


def of_bytes(raw: Raw) -> Iterator[Layer | Raw]:
    """What bytes hold: the expansion of streams, and text."""
    data, parent, locate = raw.data, raw.parent, raw.locate
    for m in STREAMS.finditer(data):
        whole = locate(m.start(), len(data))
        for piece in expansions(data, m.start()):
            yield Raw(piece, parent, lambda a, b, whole=whole: whole)
    if b"\0" in data:
        for m in UTF16_TEXT.finditer(data):
            yield Layer(m[0][::2].decode(), parent, lambda a, b, at=m.start(): locate(at + 2 * a, at + 2 * b))
    units = data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
    if 2 * len(units) == len(data) and "".join(ODD.sub("", units).split()).isprintable():
        yield Layer(units, parent, lambda a, b: locate(2 * a, 2 * b))
    try:
        text = data.decode()
    except UnicodeDecodeError:
        for m in ASCII_TEXT.finditer(data):
            yield Layer(m[0].decode(), parent, lambda a, b, at=m.start(): locate(at + a, at + b))
        return
    if len(text) == len(data):
        yield Layer(text, parent, locate)
        return
    ends = [0]
    for c in text:
        ends.append(ends[-1] + len(c.encode()))
    yield Layer(text, parent, lambda a, b: locate(ends[a], ends[b]))


def base64_layers(layer: Layer) -> Iterator[Raw]:
    """What the base64 runs of a layer hold at their four alignments."""
    for m in RUN.finditer(layer.text):
        start, raw = m.start(), m[0]
        symbols = raw.translate(URL_LETTERS)
        # Places of the symbols, where line ends stand between them.
        places = None if len(symbols) == len(raw) else [k for k, c in enumerate(raw) if c not in "\r\n"]
        for skip in range(4):
            n = len(symbols) - skip
            n -= n % 4 == 1
            if n < LEAST_RUN - 3:
                continue
            data = binascii.a2b_base64(symbols[skip : skip + n] + "=" * (-n % 4))

            def locate(a: int, b: int, skip=skip, start=start, places=places) -> tuple[int, int]:
                x, y = skip + a * 8 // 6, skip + (b * 8 - 1) // 6
                return (start + x, start + y + 1) if places is None else (start + places[x], start + places[y] + 1)

            yield Raw(data, layer, locate)


def url_layers(layer: Layer) -> Iterator[Raw]:
    """What bytes hold that are written as URL escapes and are no text."""
    if "%" not in layer.text:
        return
    for m in URL_BYTES.finditer(layer.text):
        data, ends, at, raw = bytearray(), [m.start()], 0, m[0]
        while at < len(raw):
            if raw[at] == "%" and re.match("[0-9A-Fa-f]{2}", raw[at + 1 : at + 3]):
                data.append(int(raw[at + 1 : at + 3], 16))
                at += 3
                ends.append(m.start() + at)
            else:
                more = raw[at].encode()
                data += more
                at += 1
                ends += [m.start() + at] * len(more)
        try:
            data.decode()
        except UnicodeDecodeError:
            yield Raw(bytes(data), layer, lambda a, b, ends=ends: (ends[a], ends[b]))


def wrapped(layer: Layer) -> Iterator[Layer | Raw]:
    """The layers that a layer wraps."""
    if (plain := unescaped(layer)) is not None:
        yield plain
    yield from url_layers(layer)
    yield from base64_layers(layer)


def scan(text: str, most_decoded: int = MOST_DECODED) -> tuple[list[tuple[int, int, int, int]], bool]:
    """(start, kind's number, end, depth) of all spans in order, and whether every layer was taken."""
    found: dict[tuple[int, int, int], int] = {}
    seen, held = set(), 0
    # The worklist: what is left of the layers that each layer still wraps.
    work: list[Iterator[Layer | Raw]] = [iter([Layer(text)])]
    while work:
        item = next(work[-1], None)
        if item is None:
            work.pop()
            continue
        raw = isinstance(item, Raw)
        if raw or item.parent is not None:
            content = item.data if raw else item.text.encode()
            mark = (raw, xxhash.xxh3_128_digest(content), *(item.root() if raw else item.root(0, len(item.text))))
            if not content or mark in seen:
                continue
            seen.add(mark)
            held += len(content)
            if held > most_decoded:
                return sorted((*k, d) for k, d in found.items()), False
        if raw:
            work.append(of_bytes(item))
            continue
        for a, kind, b in matches(item.text):
            x, y = item.root(a, b)
            found[x, kind, y] = min(found.get((x, kind, y), item.depth), item.depth)
        work.append(wrapped(item))
    return sorted((*k, d) for k, d in found.items()), True


def _spans(most: int, id_type: pa.DataType):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])
    schema = pa.schema([("key", id_type), ("spans", pa.list_(kind)), ("complete", pa.bool_())])

    def run(batches):
        for b in batches:
            out = [scan(t, most) for t in b.column(1).to_pylist()]
            spans = [[{"kind": KINDS[k], "start": a, "end": z, "depth": d} for a, k, z, d in found] for found, _ in out]
            yield pa.record_batch([b.column(0), pa.array(spans, schema.field(1).type), pa.array([x for _, x in out], pa.bool_())], schema=schema)

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_decoded: int = MOST_DECODED) -> DataFrame:
    """``key, spans, complete``: kind, start, end and depth (0: in the text itself) of the secrets by start, kind and end."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    kind = source.schema["key"].dataType
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("depth", "integer")
    schema = T.StructType().add("key", kind).add("spans", T.ArrayType(span)).add("complete", "boolean")
    return source.mapInArrow(_spans(most_decoded, to_arrow_type(kind)), schema)


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, mark: str, most_decoded: int = MOST_DECODED) -> str:
    """The text with every stretch of characters that belong to secrets replaced by one mark."""
    out, at, upto = [], 0, 0
    for a, _, b, _ in scan(text, most_decoded)[0]:
        if a >= upto:
            out += [text[at:a], mark]
        upto = max(upto, b)
        at = upto
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets of a text column replaced; a null text stays null."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = pa.array([t if t is None else redacted(t, mark) for t in b.column(at).to_pylist()], pa.string())
            yield pa.record_batch([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
