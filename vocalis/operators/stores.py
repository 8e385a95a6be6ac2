"""Document and job stores, replayed from their logs, and job progress."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from vocalis.functions import tables as T
from vocalis.shipping import ship


def seconds(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def ttl_replay(log: DataFrame, key: str, ts: str, event: str, ttl: int = T.DOC_TTL) -> DataFrame:
    """An access log where a miss loads the item again: a hit is an access at most ttl seconds after
    the last one (a sliding window). event tells accesses of one time apart."""
    order = Window.partitionBy(key).orderBy(ts, event)
    gap = F.col(ts) - F.lag(ts).over(order)
    return log.select(key, event, ts, F.coalesce(gap <= seconds(ttl), F.lit(False)).alias("hit"))


def fixed_ttl_replay(jobs: DataFrame, reads: DataFrame, key: str = "job_id", ttl: int = T.JOB_TTL) -> DataFrame:
    """Reads (key, read_at) of jobs (key, created): found while at most ttl seconds old."""
    age = F.col("read_at") - F.col("created")
    return reads.join(jobs, key, "left").select(*reads.columns, F.coalesce(age <= seconds(ttl), F.lit(False)).alias("found"))


def _by_store(log: DataFrame, store: str, columns: list[str], make, out: dict[str, pa.DataType]) -> DataFrame:
    """A log in order of time, a store after the other, through make(): a function of one log row that
    holds the store's state and gives the row's results. Only that state is held, not the log."""
    ship(log.sparkSession)
    kind = log.schema[store].dataType

    def run(batches):
        now, step = None, None
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if step is None or key != now:
                    now, step = key, make()
                rows.append(step(*row))
            results = [pa.array(c, t) for c, t in zip(zip(*rows), out.values())] if rows else [pa.array([], t) for t in out.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *results], names=[store, "seq", *out])

    schema = StructType([StructField(store, kind), StructField("seq", LongType()), *from_arrow_schema(pa.schema(list(out.items())))])
    ordered = log.select(store, *columns).repartition(store).sortWithinPartitions(store, "at", "seq")
    return ordered.mapInArrow(run, schema)


def store_replay(log: DataFrame, store: str, ttl: int = T.DOC_TTL, most_items: int = T.DOC_ITEMS, most_bytes: int = T.DOC_BYTES) -> DataFrame:
    """A log of puts and gets (store, seq, at in seconds, op, item, n_bytes) replayed in order of time for
    each store, which is sequential by nature: what was not used for ttl seconds goes at the next put,
    and the least recently used items go while the store is full. Adds hit (for gets), evicted (items
    that a put drove out, in order of their last use) and held (bytes in the store after the row)."""

    def make():
        live: OrderedDict[str, tuple[int, float]] = OrderedDict()  # in order of last use, so what goes stands first
        total = 0

        def leave(item):
            nonlocal total
            total -= live.pop(item)[0]
            return item

        def step(seq, at, op, item, size):
            nonlocal total
            known = live.get(item)
            if op == "get":
                hit = known is not None and at - known[1] <= ttl
                if hit:
                    live[item] = (known[0], at)
                    live.move_to_end(item)
                elif known is not None:
                    leave(item)
                return hit, [], total
            gone = []
            while live:
                oldest, (_, used) = next(iter(live.items()))
                if at - used <= ttl and len(live) < most_items and total <= most_bytes:
                    break
                gone.append(leave(oldest))
            if item in live:
                leave(item)
            live[item] = (size, at)
            total += size
            return None, gone, total

        return step

    columns = [F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "op", "item", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes")]
    return _by_store(log, store, columns, make, {"hit": pa.bool_(), "evicted": pa.list_(pa.string()), "held": pa.int64()})


def job_replay(log: DataFrame, store: str, ttl: int = T.JOB_TTL, most_items: int = T.JOB_ITEMS) -> DataFrame:
    """A log of jobs (store, seq, at in seconds, op: create, finish or read, job) replayed in order of
    time: a creation first drops jobs older than ttl seconds, then, while the store is full, the oldest
    finished one, or the oldest of all where none is finished; a read finds a job that is there and not
    too old. Adds found (for reads) and evicted."""

    def make():
        live: OrderedDict[str, list] = OrderedDict()  # in order of creation: [created, finished]

        def step(seq, at, op, job):
            gone: list[str] = []
            if op == "create":
                gone += [k for k, (created, _) in live.items() if at - created > ttl]
                left = [k for k in live if k not in gone]
                over = max(0, len(left) + 1 - most_items)
                done_first = [k for k in left if live[k][1]] + [k for k in left if not live[k][1]]
                gone += done_first[:over]
                for k in gone:
                    del live[k]
                live[job] = [at, False]
                return None, gone
            if op == "finish":
                if job in live:
                    live[job][1] = True
                return None, gone
            found = job in live and at - live[job][0] <= ttl
            if not found:
                live.pop(job, None)
            return found, gone

        return step

    columns = [F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "op", F.col("job").cast("string").alias("job")]
    return _by_store(log, store, columns, make, {"found": pa.bool_(), "evicted": pa.list_(pa.string())})


def job_answers(reads: DataFrame, states: DataFrame, job: str = "job_id") -> DataFrame:
    """Reads of jobs' results (job) against job_state: the HTTP status and why: unknown, failed, not ready
    or ready, in this order."""
    known = states.select(F.col(job).alias("_job"), F.col("phase").alias("_phase"))
    both = reads.join(known, F.col(job) == F.col("_job"), "left")
    why = F.when(F.col("_job").isNull(), "unknown").when(F.col("_phase") == "error", "failed").when(F.col("_phase") == "done", "ready").otherwise("not ready")
    code = F.when(why == "failed", 500).when(why == "ready", 200).otherwise(404)
    return both.select(*reads.columns, code.alias("status"), why.alias("why"))


def event_lines(events: DataFrame, job: str = "job_id", ts: str = "ts", beat: int = T.HEARTBEAT) -> DataFrame:
    """Each job's events as the lines that a browser reads: comments while nothing came for `beat` seconds,
    then the event's own line; nothing after an end. Adds beats (comments before the event) and line."""
    order = Window.partitionBy(job).orderBy(ts, "seq")
    ended = F.coalesce(F.max(F.col("phase").isin("done", "error").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    waited = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))
    line = F.concat(F.lit("data: "), F.to_json(F.struct("phase", "done", "total", "detail")), F.lit("\n\n"))
    some = events.withColumn("_ended", ended).withColumn("beats", F.coalesce(F.floor(waited / (beat * 1_000_000)), F.lit(0)).cast("long"))
    return some.filter("_ended = 0").drop("_ended").withColumn("line", F.concat(F.repeat(F.lit(": keep-alive\n\n"), F.col("beats").cast("int")), line))


def job_evictions(jobs: DataFrame, store: str = "store", most_items: int = T.JOB_ITEMS) -> DataFrame:
    """Which jobs (store, job_id, created, finished) of a full store stay: the oldest finished ones go
    first, running ones only if none is finished. Adds `evicted`."""
    newest_first = Window.partitionBy(store).orderBy(F.col("finished").asc(), F.col("created").desc(), F.col("job_id").desc())
    return jobs.withColumn("evicted", F.row_number().over(newest_first) > most_items)


def progress_percent(done: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0))))


def job_state(events: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Progress events (job, seq, phase, done, total, detail): last phase, percent and HTTP status of a
    job's result. Events after the first end are not seen."""
    ends = F.col("phase").isin("done", "error")
    before = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_ended", F.coalesce(F.max(ends.cast("int")).over(before), F.lit(0))).filter("_ended = 0")
    last = seen.groupBy(job).agg(F.max_by(F.struct("phase", "done", "total", "detail"), order).alias("l"), F.count(F.lit(1)).alias("n_events"))
    percent = F.when(F.col("l.phase") == "done", 100.0).otherwise(progress_percent(F.col("l.done"), F.col("l.total")))
    status = F.when(F.col("l.phase") == "error", 500).when(F.col("l.phase") == "done", 200).otherwise(404)
    return last.select(job, F.col("l.phase").alias("phase"), percent.alias("percent"), F.col("l.detail").alias("detail"), status.alias("status"), "n_events")


def latest_play(plays: DataFrame, viewer: str, order: str) -> DataFrame:
    """Only the newest playback of each viewer acts."""
    newest = Window.partitionBy(viewer).orderBy(F.desc(order))
    return plays.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
