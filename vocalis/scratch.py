"""Folders that driver and executors share, and tables in them that go with their owner."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a write go with the write.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of
    our own on one machine (master local), and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vocalis-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/") if "://" in at or at.startswith("file:") else "file://" + at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vocalis/{name}-{uuid.uuid4().hex}"


class Files:
    """Files by Hadoop's API, which a session that has stopped leaves behind."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _of(self, at: str):
        path = self.jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.conf)

    def delete(self, at: str) -> None:
        path, system = self._of(at)
        system.delete(path, True)

    def delete_at_end(self, at: str) -> None:
        """When the driver's JVM ends, whether or not Python gets to it."""
        path, system = self._of(at)
        system.mkdirs(path.getParent())
        system.mkdirs(path)  # only what is there can be marked
        system.deleteOnExit(path)


def delete(spark: SparkSession, at: str) -> None:
    Files(spark).delete(at)


@contextmanager
def tidy_writes(spark: SparkSession):
    """Within, shuffle files go when the write that made them ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_open: set["Scratch"] = set()


class Scratch:
    """The tables that one operator call writes to the shared folder. They stay while results that
    read them may be used: until their owner, who gave the scope to the call, closes it (or leaves its
    with block), or else until the driver ends. No scope touches another's tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.files = spark, [], Files(spark)
        _open.add(self)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def path(self, name: str) -> str:
        """A new folder of this scope."""
        at = new_dir(self.spark, name)
        self.files.delete_at_end(at)
        self.paths.append(at)
        return at

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write to the shared folder and read back: cuts lineage and outlives any executor."""
        at = self.path(name)
        with tidy_writes(self.spark):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def holds(self, df: DataFrame) -> bool:
        """Whether df reads a table of this scope."""
        return any(at in f for f in df.inputFiles() for at in self.paths)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scope that nothing reads any more."""
        files = df.inputFiles()
        for at in [p for p in self.paths if any(p in f for f in files)]:
            self.files.delete(at)
            self.paths.remove(at)

    def close(self) -> None:
        while self.paths:
            self.files.delete(self.paths.pop())
        _open.discard(self)


@atexit.register
def _close_all() -> None:
    for scope in list(_open):
        try:
            scope.close()
        except Py4JError:  # the JVM has gone, and has deleted what was marked
            _open.discard(scope)
