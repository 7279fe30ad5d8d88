"""Session and table access helpers."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, name: str = "wearpath") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session uses its warehouse. On a cluster a folder must be named: only there is it
    known that driver and executors share it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        current = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def visible_to_tasks(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (clusters may also ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    visible_to_tasks(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder; it goes when the program ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{purpose}-{uuid.uuid4().hex}")
    if not _FOLDERS:
        atexit.register(drop_folders)
    _FOLDERS.append((spark, path))
    return path


def drop_folders() -> None:
    """Delete the intermediates this program wrote, where the session still runs."""
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*written: DataFrame) -> None:
    """Delete intermediates of `materialise` whose last reader has finished; nothing may be read from them any more."""
    for df in written:
        entry = getattr(df, "_written_to", None)
        if entry in _FOLDERS:
            _FOLDERS.remove(entry)
            _delete(*entry)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """What is written inside goes at the end, but for the written frames put into the list; those alone may be read afterwards."""
    before, kept = set(_FOLDERS), []
    yield kept
    stay = {getattr(df, "_written_to", None) for df in kept}
    for entry in [e for e in _FOLDERS if e not in before and e not in stay]:
        _FOLDERS.remove(entry)
        _delete(*entry)


def materialise(df: DataFrame, purpose: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate that several jobs read, and go on from the written columns.

    A table in shared storage survives lost executors and is read with column pruning. ``by``: columns of few values
    that become folders, so that a filter on them reads no other rows.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if by:
        back = back.select(*df.columns)
    back._written_to = next(entry for entry in reversed(_FOLDERS) if entry[1] == path)
    return back
