"""What every plan may need of the cluster: the package on executors, and the shared folder."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[tuple[str, str]] = set()
#: Spark's default bound of an Arrow batch, and the one that replaces it: a Python worker holds a few copies of a batch.
ARROW_KEY, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it sets a bound of its own."""
    try:
        if spark.conf.get(ARROW_KEY).rstrip("b") == str(ARROW_DEFAULT):
            spark.conf.set(ARROW_KEY, str(ARROW_BYTES))
    except Exception:  # a Spark without the setting
        pass


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (Spark's own file distribution), and bound Arrow batches."""
    bound_batches(spark)
    root = Path(__file__).resolve().parent
    if root.parent.suffix == ".zip":
        return
    app = spark.sparkContext.applicationId
    if any(a == app for a, _ in _shipped):
        return
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = Path(tempfile.mkdtemp(prefix="quillon-ship-")) / f"quillon-{digest}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add((app, digest))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share.

    Only where the session sets none and the master is local (a single machine, as in tests) a temporary folder is
    used; on a cluster its absence is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if conf:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at interpreter exit
        pass


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """What runs in here has its shuffle files deleted when it ends: its result is a table or a checkpoint by then.

    Without it they stay until the driver happens to collect garbage, and steps that follow each other add up on disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(key)
    except Exception:  # a Spark without the setting
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables staged inside of the open ``scratch`` blocks.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged in here are deleted when it ends: what is read later must have been written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


@contextmanager
def kept():
    """Tables staged in here outlive an open ``scratch`` block."""
    held, _scratch[:] = list(_scratch), []
    try:
        yield
    finally:
        _scratch[:] = held


def spread(df: DataFrame) -> DataFrame:
    """A scan of few files over all cores: what has fewer partitions than there are cores is dealt out evenly, a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Staged:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        with dropping_shuffles(self.spark):
            df.select("*").write.parquet(path)
        self.paths.append(path)
        (_scratch[-1].append if _scratch else lambda p: atexit.register(_delete, self.spark, p))(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables, once no later plan reads them."""
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)
