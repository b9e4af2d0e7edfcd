"""Structured Streaming forms of what depends on arrival: append with a frozen threshold, scoring, dedup, the online readout."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import novelty, search
from ..operators.classify import AUDIT_NAMES, AUDIT_SCHEMA, Readout, audited

STATE_SCHEMA = "model binary"


def append_history(stream: DataFrame, folder: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append rows whose id the history does not hold yet; within a batch the first row of an id (by all columns) stays.

    A batch that is replayed after a failure finds its ids present and adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(folder).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def score_stream(stream: DataFrame, references: DataFrame, limit: float, width: int, sink: str, checkpoint: str) -> StreamingQuery:
    """Novelty of arriving fingerprints (``id, slots, values``) against a fixed history and a frozen threshold."""

    def score(batch: DataFrame, batch_id: int) -> None:
        found = search.nearest(batch, references, 1, "jaccard", width)
        novelty.scores(found, limit).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).start()


def unique_alerts(stream: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of every key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or, with ``slide``, sliding) windows; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def session_counts(rows: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``by, start, end, n``: sessions of rows at most ``gap`` apart; the end is the last row's time plus the gap.

    The same plan for tables and streams: a stream gives a session once the watermark has passed its end, and leaves out rows that
    come after that (:func:`split_late` keeps them).
    """
    timed = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = timed.groupBy(F.session_window(time, gap).alias("session"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def split_late(stream: DataFrame, time: str, folder: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Rows in time below ``folder/rows``, those that come too late (or have no time) below ``folder/late``, so that none is lost unseen.

    A row is late if its time lies more than ``late`` before the latest of all earlier batches. Every batch writes a partition of its
    own, and its latest time beside them: a batch that is replayed after a failure finds the same bound and replaces its own files.
    """

    def part(batch: DataFrame, number: int) -> None:
        spark, tops = batch.sparkSession, f"{folder}/tops"
        bound = None
        if number:
            earlier = spark.read.schema("top timestamp, batch long").parquet(tops).where(F.col("batch") < number)
            bound = earlier.agg(F.max("top") - F.expr(f"INTERVAL {late}")).first()[0]
        too_late = F.col(time).isNull() | (F.lit(False) if bound is None else F.col(time) < F.lit(bound))
        batch.persist()
        try:
            batch.agg(F.max(time).alias("top")).write.mode("overwrite").parquet(f"{tops}/batch={number}")
            batch.where(~too_late).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            batch.where(too_late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).start()


def online_readout_stream(stream: DataFrame, classes: list[str], rewards: dict[str, float], rate: float = 0.1, decay: float = 0.0, clip: float = 5.0) -> DataFrame:
    """Predict-then-update over ``learner, seq, slots, label``; a learner's weights are its state.

    Rows are in order of ``seq`` within a micro-batch; across batches in order of arrival.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = pickle.loads(state.get[0]) if state.exists else Readout(classes, rewards, rate, decay, clip)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, slots, label in rows[["seq", "slots", "label"]].itertuples(index=False):
            out.append(audited(model, key[0], seq, slots, label, None))
        state.update((pickle.dumps(model),))
        yield pd.DataFrame(out, columns=AUDIT_NAMES)

    return stream.groupBy("learner").applyInPandasWithState(step, AUDIT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def _similarity(a: set[int], b: set[int]) -> tuple[int, int]:
    shared = len(a & b)
    return shared, len(a) + len(b) - shared


def leader_stream(stream: DataFrame, percent: int = 75) -> DataFrame:
    """Sequential exemplar dedup per blocking key: ``block, seq, id, leader``; the exemplars so far are the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heads: list[tuple[int, set[int]]] = pickle.loads(state.get[0]) if state.exists else []
        out = []
        for seq, id_, slots in pd.concat(list(frames)).sort_values("seq", kind="stable")[["seq", "id", "slots"]].itertuples(index=False):
            own, best, score = set(slots if slots is not None else []), None, 0.0
            for head, items in heads if own else []:
                shared, union = _similarity(own, items)
                if shared * 100 >= percent * union and shared / union > score:
                    best, score = head, shared / union
            if best is None:
                best = id_
                if own:
                    heads.append((id_, own))
            out.append((key[0], seq, id_, best))
        state.update((pickle.dumps(heads),))
        yield pd.DataFrame(out, columns=["block", "seq", "id", "leader"])

    return stream.groupBy("block").applyInPandasWithState(step, "block string, seq long, id long, leader long", STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
