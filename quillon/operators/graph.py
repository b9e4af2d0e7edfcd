"""Weighted directed graphs: adjacency, transition, diffusion and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` with parallel edges summed; a weight that is not positive is an error."""
    if not edges.where(F.col("w").isNull() | (F.col("w") <= 0)).isEmpty():
        raise ValueError("edge weights must be positive")
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def transition(adj: DataFrame) -> DataFrame:
    """``src, dst, p``: weights over the sum of the source's; a node without outgoing edges has none."""
    total = adj.groupBy("src").agg(F.sum("w").alias("total"))
    return adj.join(total, "src").select("src", "dst", (F.col("w").cast("double") / F.col("total")).alias("p"))


def check_transition(p: DataFrame) -> None:
    bad = p.groupBy("src").agg(F.sum("p").alias("s"), F.min("p").alias("least")).where("least < 0 OR s > 1.0001")
    if not bad.isEmpty():
        raise ValueError("a transition must be nonnegative and substochastic")


def diffuse(p: DataFrame, state: DataFrame, steps: int, retain: float = 0.9, mix: float = 0.8) -> DataFrame:
    """``node, a`` after so many steps of a' = retain * ((1 - mix) * a + mix * inflow). Each step is cut in the shared folder.

    A transition that is negative or not substochastic is an error.
    """
    check_transition(p)
    for _ in range(steps):
        inflow = p.join(state, p["src"] == state["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("a")).alias("inflow"))
        both = state.join(inflow, "node", "full_outer")
        state = cut(both.select("node", (retain * ((1 - mix) * F.coalesce("a", F.lit(0.0)) + mix * F.coalesce("inflow", F.lit(0.0)))).alias("a")))
    return state


def pulse(nodes: DataFrame, cls: str, amplitude: float = 1.0) -> DataFrame:
    """``node, a`` of the nodes of a class."""
    if not 0 <= amplitude <= 10:
        raise ValueError("amplitude must lie between 0 and 10")
    return nodes.where(F.col("class") == cls).select("node", F.lit(float(amplitude)).alias("a"))


def frame_summary(state: DataFrame) -> DataFrame:
    return state.agg(F.sum((F.col("a") > 1e-8).cast("long")).alias("active"), F.sum("a").alias("mass"), F.max("a").alias("peak"))


def strongest(state: DataFrame, n: int = 2000) -> DataFrame:
    return state.where("a > 1e-8").orderBy(F.desc("a"), "node").limit(n)


def class_codes(nodes: DataFrame) -> DataFrame:
    """``class, code, n``: classes in order, missing ones as ``unclassified``."""
    named = nodes.select(F.coalesce("class", F.lit("unclassified")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return named.select("class", (F.dense_rank().over(Window.orderBy("class")) - 1).alias("code"), "n")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` of edge ends that are no nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def sample(rows: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of exactly n rows (all, if fewer), by a seeded hash of the key."""
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return rows.orderBy(name, *key).limit(n)
