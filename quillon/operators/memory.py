"""Mutable history as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN", "UNKNOWN")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that are missing or occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def append(history: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """History and new rows; if any id is known or repeats, an error, and nothing changes."""
    known = new.join(history.select(key), key, "left_semi")
    if not known.isEmpty() or not duplicates(new, key).isEmpty():
        raise ValueError("ids must be new and unique")
    return history.unionByName(new, allowMissingColumns=True)


def check_feedback(events: DataFrame, base: DataFrame) -> None:
    if not events.where(~F.col("verdict").isin(*VERDICTS) | F.col("verdict").isNull()).isEmpty():
        raise ValueError("unknown verdict")
    if not events.join(base.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("feedback on an unknown id")


def current(base: DataFrame, events: DataFrame) -> DataFrame:
    """``id, verdict``: the last event's verdict (by ``seq``), else the stored one. Unknown ids or verdicts are an error."""
    check_feedback(events, base)
    last = events.groupBy("id").agg(F.max_by("verdict", "seq").alias("given"))
    return base.join(last, "id", "left").select("id", F.coalesce("given", "verdict").alias("verdict"))


def audit(base: DataFrame, events: DataFrame) -> DataFrame:
    """``seq, id, previous, verdict`` of every event: what the verdict was before it. Unknown ids or verdicts are an error."""
    check_feedback(events, base)
    order = Window.partitionBy("id").orderBy("seq")
    rows = events.join(base.select("id", F.col("verdict").alias("stored")), "id")
    return rows.select("seq", "id", F.coalesce(F.lag("verdict").over(order), "stored").alias("previous"), "verdict")
