"""The session, the given tables, and the shared folder in which lineage is cut."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("braidline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether executors are in the driver's own process, with its path and folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package: those of a cluster, and those of a local session, which do not inherit the driver's sys.path."""
    context = spark.sparkContext
    if getattr(context, "_braidline_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='braidline-')}/braidline", "zip", Path(__file__).resolve().parent.parent, "braidline")
    context.addPyFile(made)  # from the driver, which serves it
    context._braidline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names that folder in spark.checkpoint.dir, or by setCheckpointDir(). Only in a local session, as in tests,
    where neither is set, one is made; anywhere else that is an error, as executors do not see the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='braidline-')}"
        spark.sparkContext.setCheckpointDir(base)
    made = f"{base.rstrip('/')}/braidline-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(made)
    if (inside := _SCRATCH.get()) is not None:
        inside.append(made)
    return made


#: The paths that shared_dir() has given, by application.
_MADE: dict[str, list[str]] = {}
#: Those given inside a scratch().
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for made in paths:
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Deletes all that the application has written to the shared folder; results that are read from there must not be used any more."""
    _delete(spark, _MADE.pop(spark.sparkContext.applicationId, []))


class scratch:
    """Inside, steps write tables that nothing needs later: at the end these are deleted. The shuffle files of each job go before the next one.

    What is to stay is written by keep(df), which with gives; no other DataFrame made inside may be used after it.
    What a scratch() inside another one keeps goes when the outer one ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.made: list[str] = []
        self.token = _SCRATCH.set(self.made)
        return self.keep

    def keep(self, df: DataFrame) -> DataFrame:
        _SCRATCH.reset(self.token)  # registered as from outside
        df = cut(df)
        self.token = _SCRATCH.set(self.made)
        release(self.spark)
        return df

    def __exit__(self, *_) -> None:
        _SCRATCH.reset(self.token)
        _delete(self.spark, self.made)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of earlier jobs that nothing refers to any more, before a step that writes many of its own."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later jobs neither recompute it nor need the executors that made it. See forget()."""
    spark = df.sparkSession
    ship(spark)
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH.get() is not None:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


class Table:
    """A table in the shared folder that grows by jobs, and is read without the plans that made it."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.path, self.schema = spark, shared_dir(spark), None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df as a further part, and gives that part alone."""
        part = f"{self.path}/part={uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(part)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(df.schema).parquet(part)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part=*")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
