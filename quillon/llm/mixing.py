"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are shuffled (by the MD5 of their id) onto a line of words, which is cut into
blocks of equal length. A schedule of slots says which source comes next: the van der Corput points
of a bit-reversed counter are mapped through the cumulative slot counts of the sources, so that any
stretch of the schedule is close to the wanted shares and the whole of it exact. The r-th slot of a
source takes its block ``r mod blocks``, in pass ``r div blocks``.

Both directions of the map are closed: the points of a source are an interval of integers, a point's
slot is its bit reversal, and the rank of a slot within its source is a sum over the dyadic parts of
the interval. So nothing is ranked by a window over a source, and a source that holds most of the
rows is spread like any other. Word positions come from sums in 4,096 hash buckets a source.

Targets: source weights share all words; a target above ``max_repeat`` times its source's size is
cut to that, and the excess reshared by weight until none is above.

Defined results. A null text has no words; a source without words has target 0 and takes nothing.
The null source is a source and ranks last. Rows that repeat an id are documents of their own.
A very long text is one row, whose words are counted in the JVM. Extra columns are ignored by :func:`mix`; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, Staged, text_or_empty

#: Most words in a block, and slots that the smallest uncut target has at least.
BLOCK_WORDS, LEAST_SLOTS = 1024, 1000
#: Hex digits of the shuffling hash that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3
#: Points of a source that one row of the first expansion stands for.
CHUNK = 1 << 16


def _reverse_bits(x: Column, bits: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, F.lit("0"))), 2, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Per source: ``source, rank, source_size, target, capped``. One row a source goes through the windows."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("rank", F.row_number().over(order)).withColumn("weight", w.cast("double"))
    by = by.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(max_repeat))
    level = (F.col("total") - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("cap", cap).withColumn("level", level).withColumn("fill", F.row_number().over(fill))
    by = by.withColumn("open", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("fill"))).over(every))
    by = by.withColumn("level", F.max(F.when(F.col("fill") == F.col("open"), F.col("level"))).over(every))
    capped = F.coalesce(F.col("fill") < F.col("open"), F.lit(True))
    return by.select("source", "rank", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"), capped.alias("capped"), "total")


def plan(by_source: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = 3) -> DataFrame:
    """Adds to the targets: ``blocks``, ``slots``, the interval ``[lo, hi)`` of the source's points and the counter's ``bits``."""
    every, order = Window.partitionBy(), Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    live = F.sum((F.col("source_size") > 0).cast("long")).over(every)
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / (3 * LEAST_SLOTS * live)))).cast("long")
    out = by_source.where("source_size > 0").withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")).cast("long"))
    near = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long")
    slots = F.when(F.col("capped"), F.col("blocks") * max_repeat).otherwise(F.least(near, F.col("blocks") * max_repeat))
    out = out.withColumn("slots", slots).withColumn("lo", F.coalesce(F.sum("slots").over(order), F.lit(0))).withColumn("hi", F.col("lo") + F.col("slots"))
    bits = F.length(F.bin(F.greatest(F.lit(1), F.sum("slots").over(every) - 1)))
    return out.withColumn("bits", bits.cast("int"))


def _parts(bound: Column) -> Column:
    """The dyadic parts of ``[0, bound)``: of each, its length in bits and the residue of its slots."""
    lengths = F.sequence(F.lit(1), F.col("bits"))

    def shifted(n: Column) -> Column:
        return F.call_function("shiftright", bound, F.col("bits") - n)

    hit = F.filter(lengths, lambda n: shifted(n) % 2 == 1)
    whole = F.call_function("shiftright", bound, F.col("bits")) > 0
    parts = F.transform(hit, lambda n: F.named_struct(F.lit("n"), n.cast("int"), F.lit("r"), _reverse_bits(shifted(n) - 1, n.cast("int"))))
    return F.when(whole, F.array(F.named_struct(F.lit("n"), F.lit(0), F.lit("r"), F.lit(0).cast("long")))).otherwise(parts)


def _below(parts: Column, slot: Column) -> Column:
    """How many earlier slots have their points in these parts."""

    def count(total: Column, part: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), part["n"])
        passed = F.call_function("shiftright", slot - part["r"] + step - 1, part["n"])
        return total + F.when(slot > part["r"], passed).otherwise(F.lit(0).cast("long"))

    return F.aggregate(parts, F.lit(0).cast("long"), count)


def schedule(planned: DataFrame) -> DataFrame:
    """``slot, source_rank, nth, block, pass``: which block of which source comes in each slot.

    A partition makes about ``CHUNK`` slots. Their number comes from one sum over the sources, since slots are made from
    so few rows that the planner would put them all in one task.
    """
    total = planned.agg(F.sum("slots")).first()[0] or 0
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))
    rows = planned.where("slots > 0").select("rank", "lo", "hi", "bits", "blocks", _parts(F.col("lo")).alias("low"), _parts(F.col("hi")).alias("high"), chunks.alias("chunk"))
    rows = rows.repartition(max(1, -(-total // CHUNK)), "rank", "chunk")
    first = F.col("lo") + F.col("chunk") * CHUNK
    rows = rows.withColumn("point", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("hi")) - 1)))
    rows = rows.withColumn("slot", _reverse_bits(F.col("point"), F.col("bits")))
    rows = rows.withColumn("nth", _below(F.col("high"), F.col("slot")) - _below(F.col("low"), F.col("slot")))
    return rows.select("slot", F.col("rank").alias("source_rank"), "nth", (F.col("nth") % F.col("blocks")).alias("block"), F.expr("nth div blocks").alias("pass"))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``key, source, size``: words of each document."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD_CLASS)).cast("long")
    return docs.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), size.alias("size"))


def lines(sizes: DataFrame) -> DataFrame:
    """Adds ``start``: where on its source's line of words a document begins, in shuffled order."""
    rows = sizes.withColumn("hash", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(by_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("key", "source", "size", (F.col("start") + F.col("offset")).alias("start"))


def _block_of(x: Column) -> Column:
    """The block of a word: the first ``source_size mod blocks`` blocks have one word more than the others."""
    q, r = F.expr("source_size div blocks"), F.col("source_size") % F.col("blocks")
    long_part = r * (q + 1)
    return F.when(x < long_part, F.floor(x / (q + 1))).otherwise(r + F.floor((x - long_part) / F.greatest(q, F.lit(1)))).cast("long")


def _bound(block: Column) -> Column:
    return block * F.expr("source_size div blocks") + F.least(block, F.col("source_size") % F.col("blocks"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: ``key, source, size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    spark: SparkSession = docs.sparkSession
    sizes = Staged(spark).write(document_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    by_source = targets(sizes, weights, max_repeat)
    planned = plan(by_source, block_words, max_repeat)
    times = schedule(planned).groupBy("source_rank", "block").agg(F.count("*").alias("times"))
    facts = planned.select(F.col("source").alias("s"), "rank", "source_size", "target", "blocks")
    with_words = lines(sizes.where("size > 0")).join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = F.col("start") + F.col("size")
    pieces = with_words.withColumn("block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(last - 1))))
    taken = F.least(last, _bound(F.col("block") + 1)) - F.greatest(F.col("start"), _bound(F.col("block")))
    pieces = pieces.withColumn("words", taken)
    # Slots are exploded from a row a source, which the planner takes for a small table: without the hint it would be broadcast.
    joined = pieces.join(times.hint("merge").select(F.col("source_rank").alias("sr"), F.col("block").alias("b"), "times"), (F.col("rank") == F.col("sr")) & (F.col("block") == F.col("b")), "left")
    out = joined.groupBy("key", "source", "size", "start", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).alias("taken")).drop("start")
    rest = by_source.select(F.col("source").alias("s"), "source_size", "target")
    empty = sizes.where("size = 0").join(rest, F.col("source").eqNullSafe(F.col("s"))).select("key", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(empty)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a document stands in it as often as its words are taken (rounded to whole documents).

    A source's extra pass takes a stretch of its line, so rounding touches one document a source. Documents of
    which nothing is taken go; documents without words weigh nothing in the mix and stay once.
    """
    taken = mix(docs, id_col, text_col, source_col, weights, max_repeat, block_words)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)).cast("int")
    taken = taken.groupBy(F.col("key").alias("__key"), F.col("source").alias("__source"), F.col("size").alias("__words")).agg(F.max(copies).alias("__copies"))
    rows = docs.withColumn("__size", F.regexp_count(text_or_empty(text_col), F.lit(WORD_CLASS)).cast("long"))
    same = F.col(id_col).eqNullSafe(F.col("__key")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words"))
    rows = rows.join(taken.where("__copies > 0").hint("shuffle_hash"), same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
