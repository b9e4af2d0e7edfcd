"""Studies over fitted models: seeds, latencies and representations."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import metrics, novelty, search
from ..runtime import cut
from . import pipeline


def representation(queries: DataFrame, history: DataFrame, metric: str, width: int, k: int = 5) -> dict[str, float | None]:
    """Mean precision at ``k`` over the queries whose family the history knows, and seconds of a novelty pass.

    Both sides are ``id, family, slots, values``.
    """
    known = history.groupBy("family").agg(F.count("*").alias("total"))
    relevant = queries.join(known, "family").select(F.col("id").alias("query"), "total")
    found = search.nearest(queries, history, k, metric, width)
    found = found.join(queries.select(F.col("id").alias("query"), "family"), "query").join(history.select(F.col("id").alias("ref"), F.col("family").alias("other")), "ref")
    precision = metrics.retrieval(found.select("query", "rank", (F.col("family") == F.col("other")).cast("int").alias("rel")), relevant, k).first()["precision"]
    began = time.perf_counter()
    novelty.scores(search.nearest(queries, history, 1, metric, width), 0.0).agg(F.count("*")).first()
    return {"precision": precision, "novelty_seconds": time.perf_counter() - began}


def latency(model: pipeline.Fitted, alerts: DataFrame, samples: int = 30, k: int = 5) -> dict[str, float]:
    """Median and 95th percentile, in milliseconds, of single warm queries evenly spaced over ``alerts``."""
    prints = cut(model.encode(alerts))
    ids = [r["id"] for r in prints.select("id").orderBy("id").collect()] if prints.count() <= 100_000 else [r["id"] for r in prints.select("id").orderBy(F.md5(F.col("id").cast("string"))).limit(samples).collect()]
    if not ids:
        raise ValueError("no query to time")
    chosen = [ids[i * len(ids) // samples] for i in range(samples)] if len(ids) >= samples else ids
    ask = lambda i: search.nearest(prints.where(F.col("id") == i), model.prints, k, "jaccard", model.shape[1]).collect()
    ask(chosen[0])
    times = []
    for i in chosen:
        began = time.perf_counter()
        ask(i)
        times.append(1000 * (time.perf_counter() - began))
    times.sort()
    at = lambda q: times[min(len(times) - 1, int(q * (len(times) - 1) + 0.5))]
    return {"median_ms": at(0.5), "p95_ms": at(0.95), "samples": float(len(times))}


def seed_sweep(alerts: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """``metric, mean, std, n`` over the models of every seed that the settings list (``experiments.seeds``)."""
    s = config.with_defaults(settings)
    rows = cut(pipeline.parted(alerts, s))
    train, test = (rows.where(F.col("split") == p) for p in ("train", "test"))
    out = []
    for seed in s["experiments"]["seeds"]:
        model = pipeline.fit(train, s | {"seed": seed})
        found = model.inspect(test).agg(F.avg("novelty").alias("mean_novelty"), F.avg(F.col("is_novel").cast("double")).alias("flag_rate")).first().asDict()
        found["threshold"] = model.limit
        if "family" in rows.columns:
            with_family = lambda prints: cut(prints.join(rows.select("id", "family"), "id"))
            found["precision_at_5"] = representation(with_family(model.encode(test)), with_family(model.prints), "jaccard", model.shape[1])["precision"]
        out += [(seed, name, float(value)) for name, value in found.items() if value is not None]
    values = rows.sparkSession.createDataFrame(out, "seed long, metric string, value double")
    return metrics.by_seed(values, "metric", "value").orderBy("metric")
