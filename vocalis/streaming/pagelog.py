"""A table of pages (doc_id, page, status, text) as a log: a base, and for each batch the pages it changed.

    path/base-n        all pages as of batch n
    path/changes-n     the pages that batch n changed
    path/_commits      an empty file of the same name for each of them that is whole

Data is written first and its commit last, so a reader sees whole versions only, and a batch that runs again
after a crash writes over what it left, or finds its commit and does nothing. A read takes the newest base
and the newest row of each page changed since; compaction makes a new base of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.operators import reading

KEY = ["doc_id", "page"]


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, kind: str) -> list[int]:
        """The numbers of whole bases or changes, in order."""
        at = self._path(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith(f"{kind}-"))

    def write(self, pages: DataFrame, kind: str, n: int) -> None:
        pages.write.mode("overwrite").parquet(f"{self.path}/{kind}-{n}")
        self.files.create(self._path(f"{self.path}/_commits/{kind}-{n}"), True).close()

    def current(self, upto: int | None = None) -> DataFrame:
        """All pages as of batch upto, the last one by default."""
        base = max(n for n in self.committed("base") if upto is None or n <= upto)
        since = [n for n in self.committed("changes") if n > base and (upto is None or n <= upto)]
        pages = self.spark.read.parquet(f"{self.path}/base-{base}").select(*KEY, "status", "text")
        if not since:
            return pages
        changed = self.spark.read.parquet(*(f"{self.path}/changes-{n}" for n in since))
        newest = changed.groupBy(*KEY).agg(F.max_by(F.struct("status", "text"), "version").alias("x")).select(*KEY, "x.*")
        return pages.join(newest.select(*KEY), KEY, "left_anti").unionByName(newest)

    def splice(self, seen: DataFrame, n: int) -> None:
        """Batch n: recognition results (doc_id, page, ocr_text) into the pages that wait for them."""
        if n in self.committed("changes"):
            return
        once = seen.groupBy(*KEY).agg(F.max_by("ocr_text", F.xxhash64("ocr_text")).alias("ocr_text"))
        waiting = self.current(n - 1).filter("status = 'needs_ocr'").join(once.select(*KEY), KEY, "left_semi")
        self.write(reading.splice_ocr(waiting, once).withColumn("version", F.lit(n)), "changes", n)

    def compact(self) -> None:
        """A base as of the last batch."""
        last = max([*self.committed("base"), *self.committed("changes")])
        if last not in self.committed("base"):
            self.write(self.current(last), "base", last)

    def vacuum(self) -> None:
        """Delete what readers of the newest base don't need; commits go first."""
        base = max(self.committed("base"))
        for kind, most in (("base", base - 1), ("changes", base)):
            for n in [n for n in self.committed(kind) if n <= most]:
                for at in (f"_commits/{kind}-{n}", f"{kind}-{n}"):
                    self.files.delete(self._path(f"{self.path}/{at}"), True)


def create(pages: DataFrame, path: str) -> Log:
    log = Log(pages.sparkSession, path)
    log.write(pages.select(*KEY, "status", "text"), "base", 0)
    return log


def splice_stream(path: str, seen: DataFrame, checkpoint: str, compact_every: int = 100):
    """Recognition results as they come into the log at path. Batches count from 1."""

    def batch(some: DataFrame, epoch: int) -> None:
        log = Log(some.sparkSession, path)
        log.splice(some, epoch + 1)
        if (epoch + 1) % compact_every == 0:
            log.compact()

    return seen.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
