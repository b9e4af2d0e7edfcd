"""Feather and NPZ files as tables. They are read on the driver, for files of bounded size (node lists, projections)."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Largest file that is read through the driver.
MAX_BYTES = 1 << 30


def _checked(path: str) -> Path:
    p = Path(path).resolve(strict=True)
    if p.stat().st_size > MAX_BYTES:
        raise ValueError("the file is too large for the driver; convert it to Parquet first")
    return p


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(_checked(path)))


def read_sparse_npz(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, w`` of a compressed-row matrix saved as ``data, indices, indptr, shape``; nothing is unpickled."""
    with np.load(_checked(path), allow_pickle=False) as z:
        data, indices, indptr, shape = (z[k] for k in ("data", "indices", "indptr", "shape"))
    if len(indptr) != shape[0] + 1 or indptr[-1] != len(data) or len(indices) != len(data):
        raise ValueError("the matrix does not fit together")
    if len(indices) and (indices.min() < 0 or indices.max() >= shape[1]) or not np.isfinite(data).all():
        raise ValueError("indices out of range or values that are not finite")
    import pandas as pd

    rows = np.repeat(np.arange(shape[0], dtype=np.int64), np.diff(indptr))
    return spark.createDataFrame(pd.DataFrame({"row": rows, "col": indices.astype(np.int64), "w": data.astype(np.float64)}))


def write_sparse_npz(edges: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """``row, col, w`` as a compressed-row matrix, for tables small enough for the driver."""
    t = edges.orderBy("row", "col").toPandas()
    indptr = np.r_[0, np.cumsum(np.bincount(t["row"], minlength=shape[0]))]
    np.savez_compressed(path, data=t["w"].to_numpy(float), indices=t["col"].to_numpy(np.int64), indptr=indptr, shape=np.array(shape))


def graph_tables(spark: SparkSession, neurons: str, classes: str, coordinates: str, connections: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of (gzipped) CSV files; ids are unique and every edge end is a node, else an error."""
    from pyspark.sql import functions as F

    from ..functions import position
    from ..operators.graph import adjacency, missing_endpoints

    read = lambda path, schema: spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    base = read(neurons, "root_id long, nt_type string")
    if not base.groupBy("root_id").count().where("root_id IS NULL OR count > 1").isEmpty():
        raise ValueError("node ids must be present and unique")
    kinds = read(classes, "root_id long, class string, super_class string")
    places = read(coordinates, "root_id long, position string").where(position(F.col("position")).isNotNull())
    places = places.groupBy("root_id").agg(F.min("position").alias("position"))
    nodes = base.join(kinds, "root_id", "left").join(places, "root_id", "left").withColumnRenamed("root_id", "node").withColumn("position", position(F.col("position")))
    edges = adjacency(read(connections, "pre_root_id long, post_root_id long, syn_count long").select(F.col("pre_root_id").alias("src"), F.col("post_root_id").alias("dst"), F.col("syn_count").alias("w")))
    if not missing_endpoints(edges, nodes).isEmpty():
        raise ValueError("an edge ends at an unknown node")
    return nodes, edges
