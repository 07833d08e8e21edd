"""Session settings, lineage cutting and shared scratch folders."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: set[str] = set()


def get_spark(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; cluster sizing is left to the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def _conf(spark: SparkSession, name: str) -> str | None:
    value = spark.conf.get(name, None)
    return value or spark.sparkContext.getConf().get(name, None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a folder of this machine only where Spark runs on it alone."""
    named = _conf(spark, "spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = _conf(spark, "spark.gridloom.scratch.dir")
    if not local:
        local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.gridloom.scratch.dir", local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder, removed when the driver's program ends."""
    path = f"{shared_folder(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(clear_scratch, spark)
    _scratch.add(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch folder made so far. Frames that read from them can't be used any more."""
    if spark.sparkContext._jsc is None:  # already stopped
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch_path``, or one below it, that no frame in use reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _scratch.discard(path)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries run inside leave no shuffle files behind, for jobs whose results are written as tables."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries run inside hand rows to Python in Arrow batches of 4 MB or less (one row at least), not of 10,000 rows whatever
    their size: a batch is held by the executor and by its worker, whole on both sides."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def settle(df: DataFrame, label: str, compression: str = "snappy", below: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, compressed, safe from lost executors.

    ``below``: a folder of ``scratch_path`` that holds the table under its label, so that ``release`` can remove it."""
    path = f"{below}/{label}" if below else scratch_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession), small_batches(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so a lost executor costs one stage, not the whole loop."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)

