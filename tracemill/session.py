"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names in ``spark.checkpoint.dir``.

    Without a name a local master gets a local folder (tests); on a cluster that folder would not be shared, so a
    RuntimeError asks for the name.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tracemill-checkpoints"))
    return context.getCheckpointDir()


def drop(df: DataFrame) -> None:
    """Removes the stored rows of a checkpoint that nothing will read again."""
    jvm = df.sparkSession._jvm
    try:
        path = jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  what is left over does no harm
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the checkpoint folder, so that later stages survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def partitioned(spark: SparkSession, size: float) -> Iterator[None]:
    """Gives shuffles planned inside enough partitions for ``size`` bytes, each of the session's advisory size; never fewer than the session has."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m").strip().lower().rstrip("b")
    unit = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(advised[-1:], 1)
    each = max(2**20, int(float(advised.rstrip("kmgt") or 64) * unit))
    try:
        spark.conf.set(name, str(max(int(before), -(-int(size) // each))))
        yield
    finally:
        spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once per application, so that they need no path of the driver's."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="tracemill-")
        path = os.path.join(folder, "tracemill.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def records(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key of a table with re-deliveries, with the named columns only; repeated keys have the same content."""
    return df.select(key, *columns).dropDuplicates([key])
