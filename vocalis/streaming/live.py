"""Structured Streaming forms of the stores and of job progress (page recognition: pagelog)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vocalis.functions import tables as T
from vocalis.scratch import Scratch
from vocalis.shipping import ship

# Spark pickles processors for workers on the driver too, which don't get what is shipped to executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that stateful processors need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingTtl(StatefulProcessor):
    """Accesses (item, at in seconds, op) of each item: hits within a window that each access renews.
    With reclaim, a timer drops the state once no access can hit any more."""

    def __init__(self, ttl: int = T.DOC_TTL, reclaim: bool = True):
        self.ttl, self.reclaim = ttl, reclaim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.used.get()
        last = last[0] if last else None
        item, event, times, ops = (np.concatenate(x) for x in zip(*((f["item"].to_numpy(), f["event_id"].to_numpy(), f["at"].to_numpy(), f["op"].to_numpy()) for f in rows)))
        order = np.lexsort((event, times))
        hits = []
        for at, op in zip(times[order].tolist(), ops[order].tolist()):
            fresh = last is not None and at - last <= self.ttl
            hits.append(op == "get" and fresh)
            last = at if op == "put" or fresh else None
        if last is None:
            self.used.clear()
        else:
            self.used.update((int(last),))
            if self.reclaim:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000)
        yield pd.DataFrame({"item": item[order], "event_id": event[order], "hit": hits})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def document_hits(accesses: DataFrame, ttl: int = T.DOC_TTL, reclaim: bool = True) -> DataFrame:
    """A stream of accesses (item, event_id, at, op) with their hits. Needs the RocksDB state store."""
    ship(accesses.sparkSession)
    return accesses.groupBy("item").transformWithStateInPandas(
        SlidingTtl(ttl, reclaim), outputStructType="item string, event_id long, hit boolean", outputMode="Append", timeMode="ProcessingTime" if reclaim else "None"
    )


def progress_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of job events (job_id, ts, phase, done, total, detail), repeats dropped, as the lines
    that a browser reads; state is bounded by the watermark."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "phase", "done"])
    return once.select("job_id", "ts", "phase", F.concat(F.lit("data: "), F.to_json(F.struct("phase", "done", "total", "detail")), F.lit("\n\n")).alias("line"))


def windowed_progress(events: DataFrame, width: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Events by phase and minute."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "phase").agg(F.count(F.lit(1)).alias("n"))


class Beats(StatefulProcessor):
    """Events of a job as lines, and a comment whenever none came for `beat` seconds; nothing after an end."""

    def __init__(self, beat: int = T.HEARTBEAT):
        self.beat = beat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", StructType([StructField("ended", LongType())]))

    def _quiet(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        f = pd.concat(list(rows)).sort_values("seq")
        ends = f["phase"].isin(["done", "error"])
        if ends.any():
            f = f[: int(ends.to_numpy().argmax()) + 1]
            self.ended.update((1,))
        self._quiet()
        if not ends.any():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.beat * 1000)
        yield pd.DataFrame({"job_id": key[0], "seq": f["seq"].astype("Int64"), "line": f["line"]})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.beat * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "seq": pd.array([None], "Int64"), "line": [": keep-alive\n\n"]})

    def close(self) -> None:
        pass


def event_line(phase: str = "phase", done: str = "done", total: str = "total", detail: str = "detail"):
    return F.concat(F.lit("data: "), F.to_json(F.struct(phase, done, total, detail)), F.lit("\n\n"))


def lines_with_beats(events: DataFrame, beat: int = T.HEARTBEAT) -> DataFrame:
    """A stream of job events (job_id, seq, phase, done, total, detail) as the lines that a browser reads, in
    order of seq within a batch, with comments (seq null) while a job is silent. Needs the RocksDB state store."""
    ship(events.sparkSession)
    some = events.select("job_id", "seq", "phase", event_line().alias("line"))
    return some.groupBy("job_id").transformWithStateInPandas(Beats(beat), outputStructType="job_id long, seq long, line string", outputMode="Append", timeMode="ProcessingTime")


class Jobs(StatefulProcessor):
    """Jobs of a store: a creation is kept for ttl seconds, whatever reads it, and then goes by itself."""

    def __init__(self, ttl: int = T.JOB_TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("job", StringType())])
        self.created = handle.getMapState("created", text, StructType([StructField("seq", LongType())]), self.ttl * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f, found = pd.concat(list(rows)).sort_values("seq"), []
        for seq, op, job in zip(f["seq"], f["op"], f["job"]):
            found.append(op == "read" and self.created.containsKey((job,)))
            if op == "create" and not self.created.containsKey((job,)):
                self.created.updateValue((job,), (int(seq),))
        yield pd.DataFrame({"store": key[0], "seq": f["seq"], "found": found})

    def close(self) -> None:
        pass


def jobs_found(log: DataFrame, ttl: int = T.JOB_TTL) -> DataFrame:
    """A stream of creations and reads (store, seq, op, job): whether a read finds its job. The lifetime is
    the state's own, set when a job is created and not renewed. Needs the RocksDB state store."""
    ship(log.sparkSession)
    return log.groupBy("store").transformWithStateInPandas(Jobs(ttl), outputStructType="store long, seq long, found boolean", outputMode="Append", timeMode="ProcessingTime")


class Progress(StreamingQueryListener):
    """Events of running queries, by name: rows read so far of a total that is known, then done or error."""

    def __init__(self, totals: dict[str, int]):
        self.totals, self.names, self.rows, self.events = totals, {}, {}, []

    def _add(self, name: str | None, phase: str, detail: str | None = None) -> None:
        if name in self.totals:
            seq = sum(e["job"] == name for e in self.events) + 1
            self.events.append({"job": name, "seq": seq, "phase": phase, "done": self.rows.get(name, 0), "total": self.totals[name], "detail": detail})

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._add(event.name, "start")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.rows[p.name] = self.rows.get(p.name, 0) + p.numInputRows
            self._add(p.name, "synth")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(self.names.get(str(event.runId)), "error" if event.exception else "done", event.exception and event.exception.partition("\n")[0][:200])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(e.values()) for e in self.events], "job string, seq long, phase string, done long, total long, detail string")


def all_now(spark: SparkSession, rows: DataFrame, order: str, key: str, transform, batches: int = 4) -> DataFrame:
    """rows as a stream of about so many batches in order of a number, through transform (of a streaming
    frame) into a sink, which is read back when all is done. State is kept in RocksDB.

    The files of one stretch of the order are written after those before it and hold each key in one file,
    so that a key's rows arrive in order however files are dealt to batches."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark)
    source, sink, checkpoint = (scratch.path(n) for n in ("stream", "sink", "checkpoint"))
    cuts = rows.agg(F.percentile_approx(order, [n / batches for n in range(1, batches)])).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = rows.filter(F.lit(low is None) | (F.col(order) > F.lit(low))).filter(F.lit(high is None) | (F.col(order) <= F.lit(high)))
        some.repartition(key).write.mode("append").parquet(source)
    files = len(spark.read.schema(rows.schema).parquet(source).inputFiles())
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // batches)).parquet(source)
    out = transform(stream)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
