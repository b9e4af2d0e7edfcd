"""Exact substring dedup with prefix-free parsing: every byte covered by an earlier 100-byte string goes.

A byte is removed when it lies in a string of ``LENGTH`` bytes, within one document, that also starts earlier
(in a document with a smaller id, or earlier in the same one). Strings are judged on the input. A document is an id with a
text: where an id has several texts (or several texts have none), they are documents of their own, in the order of their
SHA-256, and are numbered in that order before they are parsed.

Parsing. A rolling hash of ``GRAM`` bytes runs over the text; the position with the smallest hash (the last
of equals) among the grams of a string is its trigger. Every string has one, and equal strings have it at the
same place, so strings need to be compared only where triggers agree. The strings that share a trigger
occurrence form a phrase: the bytes from the first of them to the end of the last. The dictionary holds the
distinct phrases of a trigger, the parse their occurrences in corpus order (id, then position).

Corpus order. A phrase that occurs again is a repeat as a whole; a trigger with a single phrase needs
nothing more. Where a trigger has several phrases, only each one's first occurrence is looked at: the
dictionary's suffixes from the trigger on, and its prefixes up to the trigger read backwards, are sorted
(two suffix arrays with the lengths of common prefixes), so that a string of k bytes before and
``LENGTH - k`` after the trigger is a pair of ranks at depths k and ``LENGTH - k``; of equal pairs the first
in corpus order stays. This replaces a suffix array of the parse: since no string reaches beyond its trigger's
phrase, the order of strings follows from that of the dictionary's suffixes and prefixes alone, and the parse is only
needed for which occurrence comes first. Phrases of a trigger are the same if two hashes of 64 bits agree (trigger and
phrase), parts of hot phrases if their MD5 does; the strings of sorted phrases are compared byte by byte.

Plan. Triggers (about one in 39 bytes) are counted by key with map-side combination, and joined back where they
repeat (a filter of bounded size drops most others first); texts are shuffled twice, once to fetch the phrases
that need sorting and once to cut the result. A trigger with more than ``HOT`` phrases (the edge of a passage
that very many documents share) is not sorted in one task: its phrases are parted again and again, and the
first occurrence of each part is found by a key aggregation over its MD5. Joins are plain equi-joins, which adaptive execution splits where a key is hot.

Defined results. A null text has no bytes. Ids are whole numbers; a null id ranks last. Rows that repeat id
and text are one document and don't repeat each other. Texts shorter than
``LENGTH`` lose nothing. A very long text is parsed in pieces, fetched and cut as one row. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, cut, ship_package, text_or_empty
from .neardup import _BASE, _INVERSE, _mix, _powers

LENGTH, GRAM = 100, 24
#: Strings in a part of a hot phrase, by round.
WIDTHS = (16, 4, 1)
#: Phrases of a trigger that are sorted in one task; phrases sorted at a time; bytes parsed at a time.
HOT, SLAB, CHUNK = 20_000, 20_000, 2 << 20
#: More than any place: a string of Spark has at most 2^31 bytes, and 14 bits go to the bytes before the trigger.
PLACES = 1 << 46
#: Bits of the filter for each repeated trigger, and least and most bits of the whole (16 MB), which goes to every task. With
#: more triggers than fill it, it only lets more rows through.
TRIGGER_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 27
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1
U = np.uint64
_LOW = U(0xFFFFFF)


def parse(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Phrases of all texts: text, position of the trigger, fewest and most bytes before it, trigger hash, phrase hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    n_strings = np.maximum(size - length + 1, 0)
    if not n_strings.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    n = len(data)
    inverse = _powers(_INVERSE, n + 1)
    total = np.r_[U(0), np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, n))]
    hashes = _mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    # Smallest hash of a string's grams by doubling; the low bits hold the position, the last of equals first.
    low = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=U))
    span, wide = 1, length - gram + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if rest := wide - span:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    text = np.repeat(np.arange(len(texts)), n_strings)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings) + begin[text]
    trigger = (_LOW - (low & _LOW)).astype(np.int64)[at]
    first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    a, p0, p1 = trigger[first], at[first], at[np.r_[first[1:], len(at)] - 1]
    phrase = _mix((total[p1 + length] - total[p0]) * inverse[p0] + (a - p0).astype(U) * U(_BASE) + (p1 - p0).astype(U) * U(0xD6E8FEB86659FD93))
    return text[first], a - begin[text[first]], a - p1, a - p0, hashes[a].view(np.int64), phrase.view(np.int64)


def _pieces(batches):
    """(ids, offsets, bytes) of about ``CHUNK`` bytes; a longer text comes in pieces that share a string's length less one."""
    ids, offsets, held, size = [], [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
            for s in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
                piece = text[s : s + CHUNK + LENGTH - 1]
                if held and size + len(piece) > CHUNK:
                    yield np.array(ids, np.int64), np.array(offsets, np.int64), held
                    ids, offsets, held, size = [], [], [], 0
                ids.append(key)
                offsets.append(s)
                held.append(piece)
                size += len(piece)
    if held:
        yield np.array(ids, np.int64), np.array(offsets, np.int64), held


def _parse_rows(batches, bits: np.ndarray | None = None):
    for ids, offsets, texts in _pieces(batches):
        text, pos, fewest, most, g, c = parse(texts)
        if bits is not None:
            may = _may_hold(bits, g)
            text, pos, fewest, most, g, c = (x[may] for x in (text, pos, fewest, most, g, c))
        doc, pos = ids[text], pos + offsets[text]
        place = pos << 14 | fewest << 7 | most
        # The first occurrence of a trigger in its document (of this chunk) is marked.
        order = np.lexsort((pos, g, text))
        new = np.r_[True, (g[order][1:] != g[order][:-1]) | (text[order][1:] != text[order][:-1])] if len(g) else np.zeros(0, bool)
        head = np.zeros(len(g), bool)
        head[order[new]] = True
        yield pa.record_batch([pa.array(g), pa.array(c), pa.array(doc), pa.array(place), pa.array(head)], names=["g", "c", "doc", "place", "head"])


def _may_hold(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the filter of repeated triggers may hold each of these; a miss is certain."""
    u, last = g.view(U), U(len(bits) * 64 - 1)
    one, two = u & last, (u >> U(32)) & last
    test = lambda at: (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)
    return (test(one) & test(two)).astype(bool)


def trigger_filter(triggers: DataFrame) -> np.ndarray:
    """A Bloom filter of ``g``, sized by their number: at most ``MOST_BITS`` / 64 words come to the driver."""
    g, size = F.col("g"), LEAST_BITS
    wanted = TRIGGER_BITS * triggers.count()
    while size < min(wanted, MOST_BITS):
        size *= 2
    places = F.explode(F.array(g.bitwiseAND(F.lit(size - 1)), F.call_function("shiftrightunsigned", g, F.lit(32)).bitwiseAND(F.lit(size - 1)))).alias("at")
    rows = triggers.select(places).select(F.call_function("shiftright", F.col("at"), F.lit(6)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(U)


def _fetch(batches):
    """Of each document the bytes of its listed phrases, and whether their trigger is hot."""
    names = ["g", "doc", "place", "phrase", "hot"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    held: list[tuple] = []

    def out():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        lists = b.column(2)
        for i, key in enumerate(b.column(0).to_pylist()):
            text = texts[i].as_py()
            items = lists.slice(i, 1).flatten()
            for g, place, hot in zip(items.field("g").to_pylist(), items.field("place").to_pylist(), items.field("hot").to_pylist()):
                pos, fewest, most = place >> 14, place >> 7 & 127, place & 127
                held.append((g, key, place, text[pos - most : pos - fewest + LENGTH], hot))
            if len(held) > SLAB:
                yield out()
                held = []
    if held:
        yield out()


def _sorted(key: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (key, bytes), and the common prefix of each with the one before it (-1 where keys differ)."""
    rows = np.concatenate([key.astype(">i8").view(np.uint8).reshape(len(key), 8), parts], axis=1)
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable")
    after = rows[order]
    differ = after[1:] != after[:-1]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) - 8
    return order, np.r_[-1, np.where(same < 0, -1, same)]


def repeats(g: np.ndarray, doc: np.ndarray, place: np.ndarray, phrases: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of bytes before the trigger of the strings that also stand in an earlier phrase of the same trigger."""
    order = np.lexsort((place, doc))
    g, place, phrases = g[order], place[order], [phrases[i] for i in order]
    fewest, most = place >> 7 & 127, place & 127
    flat = np.frombuffer(b"".join(phrases) + bytes(2 * length), np.uint8)
    size = np.fromiter(map(len, phrases), np.int64, len(phrases))
    trigger = np.cumsum(size) - size + most
    reach = np.arange(length)
    right = np.where(reach < (length - fewest)[:, None], flat[np.minimum(trigger[:, None] + reach, len(flat) - 1)], 0).astype(np.uint8)
    back = np.arange(1, int(most.max(initial=0)) + 1)
    left = np.where(back <= most[:, None], flat[np.maximum(trigger[:, None] - back, 0)], 0).astype(np.uint8)
    (by_right, common_right), (by_left, common_left) = _sorted(g, right), _sorted(g, left)
    rank_right, rank_left = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    rows, before = [], []
    for k in range(int(fewest.min(initial=0)), int(most.max(initial=-1)) + 1):
        live = np.flatnonzero((fewest <= k) & (most >= k))
        rank_right[by_right] = np.cumsum(common_right < length - k)
        rank_left[by_left] = np.cumsum(common_left < k)
        pair = rank_right[live] * (len(g) + 1) + rank_left[live]
        _, first = np.unique(pair, return_index=True)
        again = np.ones(len(live), bool)
        again[first] = False
        rows.append(order[live[again]])
        before.append(np.full(int(again.sum()), k))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(before)


def _resolve(batches):
    """Covered stretches of a partition's phrases, which come in the order of their triggers."""
    held: list[pa.RecordBatch] = []
    count = 0

    def out(table: pa.Table):
        g, doc, place = (table.column(i).to_numpy() for i in range(3))
        row, k = repeats(g, doc, place, table.column(3).to_pylist())
        start = (place[row] >> 14) - k
        order = np.lexsort((start, doc[row]))
        d, s = doc[row][order], start[order]
        if not len(d):
            return pa.record_batch([pa.array(d), pa.array(d), pa.array(d)], names=["doc", "start", "stop"])
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + LENGTH)])
        return pa.record_batch([pa.array(d[new]), pa.array(s[new]), pa.array(s[np.r_[new[1:], len(s)] - 1] + LENGTH)], names=["doc", "start", "stop"])

    for b in batches:
        held.append(b)
        count += b.num_rows
        if count > SLAB:
            table = pa.Table.from_batches(held)
            g = table.column(0).to_numpy()
            change = np.flatnonzero(g[1:] != g[:-1])
            if len(change):  # the last trigger may go on
                yield out(table.slice(0, change[-1] + 1))
                table = table.slice(change[-1] + 1)
            held, count = table.to_batches(), table.num_rows
    if held:
        yield out(pa.Table.from_batches(held))


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of stretches."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.r_[new[1:], len(start)] - 1].tolist()))


def _finish(batches):
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        out = []
        for i, (key, has) in enumerate(zip(b.column(0).to_pylist(), b.column(2).is_valid().to_pylist())):
            text, spans = texts[i].as_py(), []
            if has:
                items = b.column(2).slice(i, 1).flatten()
                spans = [(s, min(e, len(text))) for s, e in merged(items.field("start").to_numpy(), items.field("stop").to_numpy()) if s < len(text)]
            digest, at = hashlib.sha256(), 0
            for s, e in spans:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            out.append((key, len(text), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "stop": e} for s, e in spans]))
        kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key, n_bytes, n_removed, n_spans, kept_sha256, spans`` (byte offsets)."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    stage = Staged(spark)
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text_or_empty(text_col).alias("text"))
    if not source.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        source = _numbered(source, stage)
    texts = source.select("doc", "text")
    phrases = texts.mapInArrow(_parse_rows, "g long, c long, doc long, place long, head boolean")
    # Triggers that occur again: their first occurrence, and whether all their phrases are alike.
    # Each piece of a long text has heads of its own: the first one is the least pair, not any of the document.
    # It is packed in one number, as a struct would be sorted instead of hashed.
    first_doc, pack = F.when(F.col("head"), F.col("doc")), F.lit(PLACES).cast("decimal(15,0)")
    first = F.min(first_doc.cast("decimal(20,0)") * pack + F.col("place").cast("decimal(15,0)"))
    triggers = phrases.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(first_doc).alias("fd"), F.pmod(first, pack).cast("long").alias("fp")).where("n > 1").drop("n")
    triggers = stage.write(triggers, "suffix-triggers")
    _release(spark)
    # Texts are parsed again rather than kept; the filter leaves out triggers that occur once before they are shuffled.
    bits = trigger_filter(triggers)
    repeated = texts.mapInArrow(lambda batches: _parse_rows(batches, bits), "g long, c long, doc long, place long, head boolean")
    again = repeated.drop("head").join(triggers.hint("shuffle_hash"), "g")
    alike = F.col("c0") == F.col("c1")
    first = (F.col("doc") == F.col("fd")) & (F.col("place") == F.col("fp"))
    again = again.where(~(alike & first)).select("doc", "place", F.when(~alike, F.col("g")).alias("g"), F.when(~alike, F.col("c")).alias("c"))
    again = stage.write(again, "suffix-again")
    _release(spark)
    several = again.where("g IS NOT NULL")
    heads = several.groupBy("g", "c").agg(F.min(F.struct("doc", "place")).alias("first")).select("g", "c", F.col("first.doc").alias("fd"), F.col("first.place").alias("fp"))
    heads = stage.write(heads, "suffix-heads")
    hot = heads.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("g", F.lit(True).alias("hot"))
    wanted = heads.select("g", F.col("fd").alias("doc"), F.col("fp").alias("place")).join(hot, "g", "left")
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("g", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("items"))
    fetched = texts.join(wanted.hint("shuffle_hash"), "doc").mapInArrow(_fetch, "g long, doc long, place long, phrase binary, hot boolean")
    fetched = stage.write(fetched, "suffix-fetched")
    _release(spark)
    sorted_ = fetched.where("NOT hot").select("g", "doc", "place", "phrase").repartition("g").sortWithinPartitions("g")
    edges = sorted_.mapInArrow(_resolve, "doc long, start long, stop long")
    several_hot = fetched.where("hot").select("doc", "place", "phrase")
    later = several_hot.drop("phrase").limit(0) if several_hot.isEmpty() else parted(several_hot)
    shift, low, high = _fields("place")
    span = (F.col("doc"), (shift - high).alias("start"), (shift - low + LENGTH).alias("stop"))
    copies = several.join(heads, ["g", "c"]).where((F.col("doc") != F.col("fd")) | (F.col("place") != F.col("fp")))
    covered = again.where("g IS NULL").select(*span).unionByName(copies.select(*span)).unionByName(later.select(*span)).unionByName(edges)
    per_doc = covered.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.join(per_doc.hint("shuffle_hash"), "doc", "left").select("key", "text", "spans")
    return joined.mapInArrow(_finish, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>")


def _numbered(source: DataFrame, stage: Staged) -> DataFrame:
    """``key, doc, text`` with ``doc`` the place of (id, text) among all that differ, ids in order and null last.

    Ids with the digests of their texts are sorted by ranges; only the sizes of the ranges come to the driver.
    """
    spark = source.sparkSession
    named = source.select("key", "text", F.sha2("text", 256).alias("digest"))
    order = (F.col("key").isNull(), F.col("key"), F.col("digest"))
    ranges = named.select("key", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row is its task's number and its place in the task.
    ranges = stage.write(ranges.select("key", "digest", F.monotonically_increasing_id().alias("at")), "suffix-rows")
    task = F.call_function("shiftright", F.col("at"), F.lit(33))
    sizes = sorted((r["task"], r["n"]) for r in ranges.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    before, n = [], 0
    for t, size in sizes:
        before.append((t, n))
        n += size
    before = spark.createDataFrame(before, "task long, before long")
    places = ranges.withColumn("task", task).join(F.broadcast(before), "task").select("key", "digest", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("doc"))
    both = (named["key"].eqNullSafe(places["key"])) & (named["digest"] == places["digest"])
    return stage.write(named.join(places, both).select(named["key"], places["doc"], named["text"]), "suffix-documents")


def parted(phrases: DataFrame) -> DataFrame:
    """``doc, place`` of the parts of phrases (strings next to each other) that also stand earlier as a whole.

    Parts lie in cells of a grid over the number of bytes before the trigger, ``WIDTHS`` strings wide. A part that is a
    repeat covers all its strings at once; the others go on, down to single strings, where the first occurrence of every
    string is present. Equal parts meet as counts, never as pairs.
    """
    start, low, high = _fields("place")
    out, parts = None, phrases
    for width in WIDTHS:
        # The first bytes of a phrase belong to the strings with most bytes before the trigger.
        least = lambda c: F.greatest(low, c * width)
        most = lambda c: F.least(high, c * width + (width - 1))
        one = lambda c: F.struct((start * 16384 + least(c) * 128 + most(c)).alias("place"), F.substring("phrase", (high - most(c) + 1).cast("int"), (most(c) - least(c) + LENGTH).cast("int")).alias("phrase"))
        grid = F.sequence(F.floor(low / width), F.floor(high / width))
        parts = parts.select("doc", F.explode(F.transform(grid, one)).alias("p")).select("doc", "p.place", "p.phrase", F.md5("p.phrase").alias("k"))
        first = parts.groupBy("k").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("k", F.col("first.doc").alias("fd"), F.col("first.place").alias("fp"))
        seen = parts.join(first, "k", "left").withColumn("again", F.coalesce((F.col("doc") != F.col("fd")) | (F.col("place") != F.col("fp")), F.lit(False)))
        seen = cut(seen.select("doc", "place", *(["phrase"] if width > 1 else []), "again"))
        found = seen.where("again").select("doc", "place")
        out = found if out is None else out.unionByName(found)
        parts = seen.where("NOT again").drop("again")
    return out


def _fields(place: str):
    """Position of the trigger, fewest and most bytes before it."""
    p = F.col(place)
    return F.call_function("shiftright", p, F.lit(14)), F.call_function("shiftright", p, F.lit(7)).bitwiseAND(F.lit(127)), p.bitwiseAND(F.lit(127))


def _release(spark) -> None:
    """Let Spark delete the shuffle files that no plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
