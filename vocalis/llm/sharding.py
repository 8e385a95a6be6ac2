"""Sharding of linked rows by balanced label propagation, with counts of rows at most one apart.

Rows that share a value of a key column are linked: a key is counted by shard, so a group of any size costs
its rows and never its pairs. Linked rows begin in shards by ranges of a seeded hash. In each round the keys'
counts by shard are written and joined to the rows; a row asks for the shard with most of its neighbours, ties
going to the shard that its key prefers. What is asked for is summed by (from, to, gain): a largest-gain
circulation on those few numbers, under each shard's quota of rows, says how many of each sum may move, and
ranges of the hash pick them. A shard that is full refuses, and what it refused asks for the next best, so a
group larger than a quota fills as few shards as it can. When nothing moves with every shard open, or nothing
asks, the rows without links and those that found no place are dealt out in the order of the hash, filling each quota
exactly. Slots are ranks by shard and range of the hash.

The driver sees counts by shard and range (RANGES, PICKS) and never a row, a key or a link. Joins of rows with
their keys' counts read written tables, so that Spark can split a key of a third of all rows.

Defined results: a null key links nothing; repeated rows are rows of their own and get slots of their own;
an empty table gives an empty table; fewer rows than shards leave shards empty; very long texts matter to
their keys only; columns whose names begin with an underscore are reserved.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm import common

#: Ranges of the hash that order rows, and those that pick which of the rows that ask may move.
RANGES, PICKS = 4096, 256
#: A shard with less of its quota left than this share counts as full.
FULL = 1 / 512
#: Rounds without a move, every shard open, after which propagation ends.
STALLS = 3


@dataclass(frozen=True)
class Shards:
    n: int = 8
    rounds: int = 24
    seed: int = 29


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def circulation(asked: dict[tuple[int, int, int], int], room: list[int]) -> dict[tuple[int, int, int], int]:
    """Of asked, rows by (from, to, gain), how many of each move so that the sum of gains is largest and no
    shard takes in more than it gives and has room for. From -1: not placed yet."""
    n, moved = len(room), dict.fromkeys(asked, 0)
    hub, out = n + 1, n  # rows pass the hub to stand for room taken up and for room made
    taken = [0] * n  # net intake of each shard
    lines = defaultdict(list)
    for f, t, g in asked:
        lines[(out if f < 0 else f), t].append((f, t, g))
    for v in lines.values():
        v.sort(key=lambda m: -m[2])

    def arcs():
        """The cheapest way left between each two: (from, to, cost, room, move or None, direction)."""
        for (a, b), moves in lines.items():
            if m := next((m for m in moves if moved[m] < asked[m]), None):
                yield a, b, -m[2], asked[m] - moved[m], m, 1
            if m := next((m for m in reversed(moves) if moved[m]), None):
                yield b, a, m[2], moved[m], m, -1
        yield hub, out, 0, 1 << 62, None, 0
        yield out, hub, 0, 1 << 62, None, 0
        for s in range(n):
            yield hub, s, 0, 1 << 62, None, 0
            if room[s] > taken[s]:
                yield s, hub, 0, room[s] - taken[s], None, 0

    while True:
        every = list(arcs())
        cost, by, last = [0] * (n + 2), [None] * (n + 2), None
        for _ in range(n + 2):
            last = None
            for arc in every:
                if cost[arc[0]] + arc[2] < cost[arc[1]]:
                    cost[arc[1]], by[arc[1]], last = cost[arc[0]] + arc[2], arc, arc[1]
            if last is None:
                return moved
        for _ in range(n + 2):  # now on the cycle
            last = by[last][0]
        cycle, at = [], last
        while not cycle or at != last:
            cycle.append(by[at])
            at = by[at][0]
        step = min(arc[3] for arc in cycle)
        for *_, m, way in cycle:
            if m:
                moved[m] += way * step
                taken[m[1]] += way * step
                if m[0] >= 0:
                    taken[m[0]] -= way * step


def admitted(asked: dict[tuple[int, int, int], dict[int, int]], load: list[int], quota: list[int]) -> tuple[dict, list[int]]:
    """asked: rows by (from, to, gain) and range. Returns how many ranges of each may move, and the loads
    then, within the quotas."""
    room = [q - x for q, x in zip(quota, load)]
    moves = circulation({k: sum(v.values()) for k, v in asked.items()}, room)
    upto, count = {}, {}

    def prefix(k: tuple, most: int) -> None:
        n = 0
        for r in range(PICKS):
            if n + asked[k].get(r, 0) > most:
                upto[k], count[k] = r, n
                return
            n += asked[k].get(r, 0)
        upto[k], count[k] = PICKS, n

    for k, most in moves.items():
        prefix(k, most)
    while True:
        then = list(load)
        for (f, t, _), n in count.items():
            then[t] += n
            if f >= 0:
                then[f] -= n
        over = next((s for s in range(len(load)) if then[s] > quota[s]), None)
        if over is None:
            return upto, then
        k = min((k for k in count if k[1] == over and count[k]), key=lambda k: k[2])
        prefix(k, max(0, count[k] - (then[over] - quota[over])))


def _preference(seed: int, key: Column, shards: int) -> Column:
    return F.array(*(F.xxhash64(F.lit(seed + s), key) for s in range(shards)))


def _near(rows: DataFrame, keys: list[str], shards: int, scratch: common.Scratch) -> list[DataFrame]:
    """For each key column a written table: key and how many rows of each shard have it."""
    out = []
    for k in keys:
        per = [F.count_if(F.col("_shard") == s) for s in range(shards)]
        near = rows.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_of")).agg(F.array(*per).alias("_n"))
        out.append(scratch.write(near, "near"))
    return out


def _asking(rows: DataFrame, keys: list[str], near: list[DataFrame], how: Shards, open_: list[int], turn: int) -> DataFrame:
    """Adds _to, the shard that a row asks for (its own: to stay), and _gain, a power of two."""
    zero = F.array_repeat(F.lit(0).cast("long"), how.n)
    score = zero
    for i, (k, n) in enumerate(zip(keys, near)):
        n = n.select(F.col("_of").alias(f"_of{i}"), F.col("_n").alias(f"_n{i}"))
        rows = rows.join(n, F.col(k) == F.col(f"_of{i}"), "left")
        score = F.zip_with(score, F.coalesce(f"_n{i}", zero), lambda a, b: a + b)
    # another preference each round: what asked in vain for one shard may find a partner to swap with
    prefer = _preference(how.seed + how.n * turn, F.coalesce(*(F.col(k).cast("string") for k in keys)), how.n)
    rows = rows.withColumn("_score", F.zip_with(score, prefer, lambda n, p: F.struct(n.alias("n"), p.alias("p"))))
    best = lambda s: F.struct(F.get("_score", F.lit(s))["n"].alias("n"), F.get("_score", F.lit(s))["p"].alias("p"), F.lit(s).alias("s"))
    # on a tie an open shard is better than a full one, which the rest of the group can't enter
    prefers = F.when(F.col("_shard").isin(open_), F.get("_score", "_shard")["p"]).otherwise(F.lit(-(2**63)))
    here = F.struct(F.coalesce(F.get("_score", "_shard")["n"], F.lit(-1)).alias("n"), prefers.alias("p"), F.col("_shard").alias("s"))
    rows = rows.withColumn("_best", F.greatest(here, *(best(s) for s in open_))).withColumn("_here", here)
    gain = F.floor(F.log2(F.col("_best.n") - F.greatest(F.col("_here.n"), F.lit(0)) + 1)).cast("int")
    return rows.withColumn("_to", F.col("_best.s")).withColumn("_gain", F.pow(F.lit(2), gain).cast("long")).drop("_score", "_best", "_here", *(f"_{c}{i}" for c in ("of", "n") for i in range(len(keys))))


def _linked(rows: DataFrame, keys: list[str], scratch: common.Scratch) -> DataFrame:
    """Adds _linked: whether another row shares a key."""
    linked = F.lit(False)
    for i, k in enumerate(keys):
        shared = rows.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_of{i}")).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
        rows = rows.join(scratch.write(shared, "shared-keys"), F.col(k) == F.col(f"_of{i}"), "left")
        linked = linked | F.col(f"_of{i}").isNotNull()
    return rows.withColumn("_linked", linked).drop(*(f"_of{i}" for i in range(len(keys))))


def _first_shards(linked: dict[int, int], quota: list[int]) -> dict[int, int]:
    """Linked rows by range of the hash: the shard of each range, -1 where it fits in none."""
    total, rows, shard, load, out = sum(linked.values()), sum(quota), 0, [0] * len(quota), {}
    ends, done = [], 0
    for q in quota:
        done += q
        ends.append(done)
    passed = 0
    for r in sorted(linked):
        while shard < len(quota) - 1 and (passed + linked[r] / 2) * rows >= ends[shard] * total:
            shard += 1
        fits = load[shard] + linked[r] <= quota[shard]
        out[r] = shard if fits else -1
        load[shard] += linked[r] if fits else 0
        passed += linked[r]
    return out


def _small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of counts by shard and range: at most (shards + 1) * RANGES rows."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def shard(rows: DataFrame, keys: list[str], order: list[str], how: Shards = Shards(), scratch: common.Scratch | None = None) -> DataFrame:
    """rows: narrow, for all its columns are written each round. keys: columns whose equal values link rows.
    order: columns whose seeded hash orders rows. Adds shard and slot, gapless from 0 in each shard."""
    scratch = common.scope(rows, scratch)
    columns = rows.columns
    hashed = F.xxhash64(F.lit(how.seed), *(F.col(c) for c in order))
    narrow = rows.withColumn("_hash", hashed)
    narrow = narrow.withColumn("_range", (F.shiftright("_hash", 52) + RANGES // 2).cast("int")).withColumn("_pick", F.pmod("_hash", F.lit(PICKS)).cast("int"))
    narrow = scratch.write(narrow, "shard-rows")
    state = scratch.write(_linked(narrow, keys, scratch), "shard-linked")
    counts = state.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.count_if("_linked").alias("k")).collect()  # a row for each range
    quota = quotas(sum(r["n"] for r in counts), how.n)
    first = _first_shards({r["_range"]: r["k"] for r in counts if r["k"]}, quota)
    start = _small(state, list(first.items()), "_r int, _shard int")
    alone = state.filter("not _linked").withColumn("_shard", F.lit(-1))
    state = state.filter("_linked").join(start, F.col("_range") == F.col("_r"), "left").drop("_r")
    load = [sum(r["k"] for r in counts if first.get(r["_range"]) == s) for s in range(how.n)]
    state, closed, before, stalls = scratch.write(state, "shard-state"), set(), None, 0
    for turn in range(how.rounds):
        near = _near(state, keys, how.n, scratch)
        open_ = [s for s in range(how.n) if s not in closed]
        asking = scratch.write(_asking(state, keys, near, how, open_, turn), "shard-asking")
        for t in [*near, *([before] if before else [])]:
            scratch.drop(t)
        before, asked = asking, defaultdict(dict)
        moves = asking.filter("_to != _shard").groupBy("_shard", "_to", "_gain", "_pick").agg(F.count(F.lit(1)).alias("n"))
        for r in moves.collect():  # counts: at most shards^2 * 40 gains * PICKS rows
            asked[r["_shard"], r["_to"], r["_gain"]][r["_pick"]] = r["n"]
        upto, load = admitted(asked, load, quota)
        may = _small(state, [(*k, v) for k, v in upto.items()], "_f int, _t int, _g long, _upto int")
        moving = (F.col("_shard") == F.col("_f")) & (F.col("_to") == F.col("_t")) & (F.col("_gain") == F.col("_g"))
        state = asking.join(may, moving, "left").withColumn("_shard", F.when(F.col("_pick") < F.col("_upto"), F.col("_to")).otherwise(F.col("_shard")))
        state = state.drop("_f", "_t", "_g", "_upto", "_to", "_gain")
        if not any(n for k, v in upto.items() for r, n in asked[k].items() if r < v):
            stalls += not closed
            if stalls == STALLS or not closed and not asked:
                break
            closed = set()
            continue
        stalls = 0
        refused = {k[1] for k, v in upto.items() if any(r >= v for r in asked[k])}
        closed |= {s for s in refused if quota[s] - load[s] <= FULL * quota[s]}
        closed = closed if len(closed) < how.n else set()
    return _slots(state.unionByName(alone), columns, quota, order, how, scratch)


def _slots(state: DataFrame, columns: list[str], quota: list[int], order: list[str], how: Shards, scratch: common.Scratch) -> DataFrame:
    """Deals out the rows without a shard and ranks all."""
    state = scratch.write(state, "shard-placed")
    placed, offsets = defaultdict(int), []
    for r in sorted(state.groupBy("_shard", "_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_shard"], r["_range"], placed[r["_shard"]]))
        placed[r["_shard"]] += r["n"]
    within = Window.partitionBy("_shard", "_range").orderBy("_hash", *order)
    ranked = state.withColumn("_nth", F.row_number().over(within) - 1)
    ranked = ranked.join(_small(state, offsets, "_s int, _r int, _offset long"), (F.col("_shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    rank = F.col("_offset") + F.col("_nth")
    starts, done = [], 0
    for s in range(how.n):
        starts.append(done)
        done += quota[s] - placed[s]
    late = sum((F.when(rank >= F.lit(x), 1).otherwise(0) for x in starts[1:]), F.lit(0))
    there = F.when(F.col("_shard") >= 0, F.col("_shard")).otherwise(late)
    ranked = ranked.withColumn("shard", there.cast("int"))
    of = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard") + 1)
    slot = F.when(F.col("_shard") >= 0, rank).otherwise(rank - of(starts) + of([placed[s] for s in range(how.n)]))
    return ranked.select(*columns, "shard", slot.cast("long").alias("slot"))


def link_digest(text: Column) -> Column:
    """Equal texts have equal digests; a null text has none."""
    return F.unhex(F.sha2(text, 256))


def cut(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """By key column: links (pairs of rows that share a value) and cut_links (in two shards), from counts."""
    out = None
    for k in keys:
        by = assigned.filter(F.col(k).isNotNull()).groupBy(k, "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
        pairs = by.groupBy(k).agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("links"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
        one = pairs.agg(F.lit(k).alias("key"), F.coalesce(F.sum("links"), F.lit(0.0)).alias("links"), F.coalesce(F.sum(F.col("links") - F.col("kept")), F.lit(0.0)).alias("cut_links"))
        out = one if out is None else out.unionByName(one)
    return out
