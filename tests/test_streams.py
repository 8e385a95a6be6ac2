"""Streams: the log of page versions, beats, lifetimes in state, progress of running queries."""

import os
import time

from pyspark.sql import functions as F

from vocalis.operators import stores
from vocalis.streaming import live, pagelog

PAGES = "doc_id long, page int, status string, text string"
SEEN = "doc_id long, page int, ocr_text string"


def test_page_log(spark, tmp_path):
    at, seen = str(tmp_path / "pages"), str(tmp_path / "seen")
    log = pagelog.create(spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("id") < 1_990, "ready").otherwise("needs_ocr").alias("status"), F.lit("").alias("text")), at)

    def add(*rows):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(seen)

    def go(every=100):
        q = pagelog.splice_stream(at, spark.readStream.schema(SEEN).parquet(seen), str(tmp_path / "c"), every).start()
        q.processAllAvailable()
        q.stop()
        assert log.current().count() == 2_000
        return {r.doc_id: (r.status, r.text) for r in log.current().filter("doc_id >= 1990 and status <> 'needs_ocr' or text <> ''").collect()}

    def size(name):
        return spark.read.parquet(f"{at}/{name}").count()

    add((1_990, 1, "Visto."), (5, 1, "non in attesa"), (9_999, 1, "altrove"))
    assert go() == {1_990: ("ready", "Visto.")} and size("changes-1") == 1
    add((1_991, 1, None), (1_992, 1, " "))
    want = {1_990: ("ready", "Visto."), 1_991: ("ocr_failed", ""), 1_992: ("empty", "")}
    assert go() == want and size("changes-2") == 2

    def uncommit(batch, changes):
        for name in (str(batch), f".{batch}.crc"):
            (tmp_path / "c" / "commits" / name).unlink()
        if changes:  # the crash came before the log's own commit
            os.unlink(f"{at}/_commits/changes-{batch + 1}")

    for changes in (False, True):
        uncommit(1, changes)
        assert log.committed("changes") == ([1] if changes else [1, 2])
        assert go() == want and size("changes-2") == 2
    (tmp_path / "pages" / "changes-3").mkdir()  # begun, not whole
    assert log.current().count() == 2_000 and log.committed("changes") == [1, 2]
    log.compact()
    log.compact()
    assert log.committed("base") == [0, 2] and size("base-2") == 2_000
    log.vacuum()
    assert log.committed("base") == [2] and log.committed("changes") == [] and not os.path.exists(f"{at}/base-0") and go() == want
    add((1_993, 1, "Altro."))
    assert go(every=3) == want | {1_993: ("ready", "Altro.")} and log.committed("base") == [2, 3]


def test_comments_while_a_job_is_silent(spark, tmp_path):
    columns = "job_id long, seq long, phase string, done int, total int, detail string"
    at = str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(at)

    add((1, 1, "synth", 0, 2, None), (2, 1, "synth", 0, 1, None), (2, 2, "done", 1, 1, None), (2, 3, "late", 1, 1, None))
    q = live.lines_with_beats(spark.readStream.schema(columns).parquet(at), beat=1).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        lines = lambda job: [r.line for r in spark.table("beats").filter(F.col("job_id") == job).collect()]
        end = time.time() + 90
        while sum("keep-alive" in x for x in lines(1)) < 2 and time.time() < end:
            time.sleep(0.5)
        assert sum("keep-alive" in x for x in lines(1)) >= 2
        add((1, 2, "error", None, None, "x"), (2, 4, "synth", 1, 1, None))
        while len([x for x in lines(1) if "error" in x]) < 1 and time.time() < end:
            time.sleep(0.5)
        n = len(lines(1))
        time.sleep(4)
        assert len(lines(1)) == n and lines(1)[-1].startswith('data: {"phase":"error"')
        assert [x.split('"')[3] for x in lines(2)] == ["synth", "done"]
    finally:
        q.stop()


def test_lifetime_of_jobs_in_state(spark, tmp_path):
    columns = "store long, seq long, op string, job string"
    at, ttl = str(tmp_path / "in"), 8

    def add(*rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(at)

    add((1, 1, "create", "a"), (1, 2, "read", "a"), (1, 3, "read", "b"), (2, 4, "read", "a"))
    q = live.jobs_found(spark.readStream.schema(columns).parquet(at), ttl).writeStream.format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).start()
    found = lambda: {r.seq: r.found for r in spark.table("jobs").collect()}

    def until(seq):
        """Timers keep such a query busy, so that it is never through with all there is."""
        end = time.time() + 60
        while seq not in found() and time.time() < end:
            time.sleep(0.2)

    try:
        until(4)
        began = time.time()
        assert found() == {1: False, 2: True, 3: False, 4: False}
        add((1, 5, "read", "a"), (1, 6, "create", "a"))  # neither renews it
        until(6)
        early = time.time() - began
        time.sleep(max(0.0, ttl + 1 - early))
        add((1, 7, "read", "a"))
        until(7)
        got = found()
        assert got[7] is False and (got[5] is True or early > ttl - 3)
        # the same log by time: what a fixed lifetime finds
        times = spark.createDataFrame([("a", 0, 0), ("a", 7, 9)], "job_id string, seq long, t long")
        day = F.timestamp_seconds(F.lit(1_700_000_000))
        jobs = times.filter("seq = 0").select("job_id", day.alias("created"))
        reads = times.filter("seq = 7").select("job_id", "seq", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("read_at"))
        assert [r.found for r in stores.fixed_ttl_replay(jobs, reads, ttl=ttl).collect()] == [got[7]]
    finally:
        q.stop()


def test_progress_of_running_exports(spark, tmp_path):
    at = str(tmp_path / "in")
    for n in (3, 2, 4):
        spark.range(n).select(F.col("id").cast("string").alias("chunk")).coalesce(1).write.mode("append").parquet(at)
    listener = live.Progress({"good": 9, "bad": 9})
    spark.streams.addListener(listener)

    def run(name, chunk):
        some = spark.readStream.schema("chunk string").option("maxFilesPerTrigger", 1).parquet(at)
        return some.select(chunk.alias("n")).writeStream.format("parquet").queryName(name).option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()

    try:
        run("good", F.length("chunk")).awaitTermination()
        try:
            run("bad", F.raise_error(F.lit("no voice"))).awaitTermination()
        except Exception:  # noqa: BLE001 - as meant
            pass
        end = time.time() + 30
        while {e["job"] for e in listener.events if e["phase"] in ("done", "error")} != {"good", "bad"} and time.time() < end:
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(listener)
    good = listener.table(spark).filter("job = 'good'").orderBy("seq").collect()
    assert [(r.phase, r.done) for r in good] == [("start", 0), ("synth", 3), ("synth", 5), ("synth", 9), ("done", 9)]
    assert {r.total for r in good} == {9}
    states = {r.job_id: (r.phase, r.status) for r in stores.job_state(listener.table(spark).withColumnRenamed("job", "job_id")).collect()}
    assert states == {"good": ("done", 200), "bad": ("error", 500)}
