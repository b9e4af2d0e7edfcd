"""Chronological splits and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a first pass; each pass narrows an ordinal's interval by so much.
BUCKETS = 4096


def ordinal_values(df: DataFrame, value: Column, ordinals: list[int]) -> list[int | None]:
    """The values at ordinals (from 0) of a sorted whole-number column.

    Counting passes over ever smaller intervals; only ``BUCKETS`` counts a pass come to the driver, so
    neither a global sort nor a single-task window is needed.
    """
    rows = df.select(value.cast("long").alias("v"))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    out: list[int | None] = []
    for k in ordinals:
        if not n:
            out.append(None)
            continue
        a, b, before, rest = low, high, 0, min(max(k, 0), n - 1)
        while a < b:
            width = max(1, -(-(b - a + 1) // BUCKETS))
            bucket = F.expr(f"(v - {a}) div {width}L")
            counts = rows.where(F.col("v").between(a, b)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
            for i, c in sorted((r["b"], r["n"]) for r in counts):
                if before + c > rest:
                    a, b = a + i * width, min(b, a + (i + 1) * width - 1)
                    break
                before += c
        out.append(a)
    return out


def chronological_split(df: DataFrame, order: Column, train: float = 0.7, validation: float = 0.15, name: str = "split") -> DataFrame:
    """Adds ``split``: rows before the value at ordinal int(n * train) are train, and so on; equal values stay together.

    ``order`` is a whole number (for times: microseconds). Fewer than ten rows, a missing value or an empty part is an error.
    """
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise ValueError("ratios must be positive and leave a test part")
    rows = df.withColumn("__order", order.cast("long"))
    n, known = rows.agg(F.count("*"), F.count("__order")).first()
    if n < 10:
        raise ValueError("a chronological split needs at least ten rows")
    if known < n:
        raise ValueError("a chronological split needs valid timestamps")
    first, second = ordinal_values(rows, F.col("__order"), [int(n * train), int(n * (train + validation))])
    low, high = rows.agg(F.min("__order"), F.max("__order")).first()
    if not low < first < second <= high:
        raise ValueError("equal timestamps leave an empty part")
    part = F.when(F.col("__order") < first, "train").when(F.col("__order") < second, "validation").otherwise("test")
    return rows.withColumn(name, part).drop("__order")


def held_out_leaks(df: DataFrame, held_out: list[str], family: str = "family", split: str = "split") -> DataFrame:
    """``family, split, n`` of held-out families that occur before the test part; none if nothing leaks."""
    found = df.where(F.col(family).isin(held_out) & (F.col(split) != "test"))
    return found.groupBy(family, split).agg(F.count("*").alias("n"))


def with_unseen(df: DataFrame, train: DataFrame, family: str = "family") -> DataFrame:
    """Adds ``is_unseen``: the row's family does not occur in ``train``."""
    seen = train.select(F.col(family).alias("__seen")).distinct()
    return df.join(seen, F.col(family) == F.col("__seen"), "left").withColumn("is_unseen", F.col("__seen").isNull()).drop("__seen")


def split_summary(df: DataFrame, time: str, by: list[str], split: str = "split") -> DataFrame:
    return df.groupBy(split, *by).agg(F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
