"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources that a document belongs to). On the
driver, from those sums alone, words flow from patterns to the quotas of their sources; a pattern's
first pass over its documents is free, each further one costs more (convex), and no pass beyond
max_passes exists. The flow tells how often each pattern is passed over whole and how many words of
one more pass it gives; for that pass documents are taken in the order of a seeded hash.

Costs stand on the arcs into patterns only, so cheapest paths come in the order of passes: the flow of
least cost is a maximum flow with the first passes, enlarged to one with the second, and so on, each
found by Dinic's algorithm. Sources of no overlapping pattern have a closed form. The driver sees a row of
sums for each source and for each pattern of several sources, however many there are, and never a document.

The order is found without sorting a pattern: sizes are summed by range of the hash, the range that
holds the cut is found from those sums, and only its documents are ranked. A document that would
overshoot is left out and the gap closed by the largest documents that fit.

Defined results: a null text has size 0 and is taken 0 words; null is a source of its own, last;
documents of no source (an empty array) are not taken; rows of one id and size are taken or left
together; very long texts count whole; an empty table gives an empty table; columns of docs that share a
name with a result stand in `row`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm import common

#: Ranges of the seeded hash for each pattern.
RANGES = 4096
#: Patterns up to which the plan, a row for each, is broadcast; beyond, it joins as it comes.
MOST_BROADCAST = 10_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    max_passes: int = 3
    seed: int = 17


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], cap: float) -> dict[str | None, float]:
    """Shares of all words by weight, in code point order with null last; what is above cap times a
    source's own size is shared again by weight among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = np.array([weights[i % len(weights)] for i in range(len(names))], float)
    most = cap * np.array([sizes[s] for s in names], float)
    out, free = np.zeros(len(names)), np.ones(len(names), bool)
    while True:
        out[free] = (most.sum() / cap - most[~free].sum()) * weight[free] / weight[free].sum()
        over = free & (out > most)
        if not over.any():
            return dict(zip(names, out.tolist()))
        out[over] = most[over]
        free &= ~over


def route(supply: dict[tuple, int], quota: dict, passes: int) -> dict[tuple, int]:
    """Words that each pattern gives; supply: pattern (its sources) to words, quota: source to words."""
    given, mixed = {}, {x for p in supply if len(p) > 1 for x in p}
    shared = [p for p in supply if not mixed.isdisjoint(p)]
    for p in supply:
        given[p] = min(quota[p[0]], passes * supply[p]) if len(p) == 1 and p[0] not in mixed else 0
    if not shared:
        return given
    sources = sorted(mixed, key=lambda x: (x is None, x or ""))
    place = {x: len(shared) + i for i, x in enumerate(sources)}
    source, sink = len(shared) + len(sources), len(shared) + len(sources) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room = [], []

    def arc(a: int, b: int, capacity: int) -> None:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)

    for i, p in enumerate(shared):
        for x in p:
            arc(i, place[x], passes * supply[p])
    for x in sources:
        arc(place[x], sink, quota[x])
    enter = len(to)
    for i in range(len(shared)):
        arc(source, i, 0)
    for _ in range(passes):
        for i, p in enumerate(shared):
            room[enter + 2 * i] += supply[p]
        _enlarge(graph, to, room, source, sink)
    for i, p in enumerate(shared):
        given[p] = room[enter + 2 * i + 1]
    return given


def _enlarge(graph: list[list[int]], to: list[int], room: list[int], source: int, sink: int) -> None:
    """To a maximum flow: rounds of blocking flows along shortest paths, walked with an explicit stack."""
    while True:
        level = [-1] * len(graph)
        level[source], line = 0, [source]
        for a in line:
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return
        at, path, a = [0] * len(graph), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            arcs = graph[a]
            while at[a] < len(arcs) and not (room[arcs[at[a]]] and level[to[arcs[at[a]]]] == level[a] + 1):
                at[a] += 1
            if at[a] < len(arcs):
                path.append(arcs[at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def mix(docs: DataFrame, text: str = "text", sources: Column | None = None, how: Mix = Mix(), keep: list[str] | None = None, salt: list[str] | None = None, scratch: common.Scratch | None = None) -> DataFrame:
    """sources: an array column of a document's sources (by default array(source)). Returns `row`
    (struct of the columns in keep), size, pattern, pattern_size, target (of a pattern with one
    source its source's, else null) and taken. salt: columns that tell documents apart for the hash."""
    spark, scratch = docs.sparkSession, common.scope(docs, scratch)
    keep = docs.columns if keep is None else keep
    salt = ["doc_id"] if salt is None else salt
    sources = F.array("source") if sources is None else sources
    facts = [
        F.size(common.words(F.col(text))).cast("long").alias("size"),
        F.array_sort(F.array_distinct(sources)).alias("pattern"),
        F.xxhash64(F.lit(how.seed), *(F.col(c) for c in salt)).alias("hash"),
    ]
    # ranges of the hash in its own order, so that all documents of a range stand before the next
    hash_range = (F.shiftright("hash", 52) + RANGES // 2).cast("int").alias("range")
    narrow = scratch.write(docs.select(*facts), "mix").select("*", hash_range)
    # a range has a row at most for each pattern; sums are combined before they are shuffled
    sums = scratch.write(narrow.groupBy("pattern", "range").agg(F.sum("size").alias("words")), "mix-sums")
    supply = {tuple(r["pattern"]): int(r["w"]) for r in sums.groupBy("pattern").agg(F.sum("words").alias("w")).collect()}
    by_source: dict[str | None, int] = {}
    for p, n in supply.items():
        for x in p:
            by_source[x] = by_source.get(x, 0) + n
    share = targets(by_source, how.weights, how.max_passes) if by_source else {}
    given = route(supply, {x: round(v) for x, v in share.items()}, how.max_passes)

    plan = {}
    for p, n in supply.items():
        whole, rest = divmod(given[p], n) if n else (0, 0)
        plan[p] = {"pattern_size": n, "target": share[p[0]] if len(p) == 1 else None, "whole": whole, "rest": rest}

    def planned(*columns: str) -> DataFrame:
        types = {"target": "double", "cut_range": "int", "extra": "array<struct<hash:long,size:long>>"}
        rows = [(list(p), *(v.get(c) for c in columns)) for p, v in plan.items()]
        frame = spark.createDataFrame(rows, ", ".join(["of array<string>", *(f"{c} {types.get(c, 'long')}" for c in columns)]))
        return F.broadcast(frame) if len(plan) <= MOST_BROADCAST else frame

    def with_plan(df: DataFrame, *columns: str) -> DataFrame:
        return df.join(planned(*columns), F.col("pattern").eqNullSafe(F.col("of")), "left")

    # the range that holds the cut: the words before it are all taken
    order = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = with_plan(sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))), "rest")
    for r in before.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).collect():
        plan[tuple(r["pattern"])] |= {"cut_range": r["range"], "cut_before": r["before"]}
    # rank only the documents of the cut's range
    edge = with_plan(narrow, "rest", "cut_range", "cut_before").filter(F.col("range") == F.col("cut_range"))
    edge = edge.groupBy("pattern", "hash", "size", "rest", "cut_before").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("up_to", F.col("cut_before") + F.sum("words").over(run)).filter(F.col("up_to") <= F.col("rest"))
    for r in edge.groupBy("pattern").agg(F.max(F.struct("up_to", "hash", "size")).alias("x")).select("pattern", "x.*").collect():
        plan[tuple(r["pattern"])] |= {"last_hash": r["hash"], "last_size": r["size"], "up_to": r["up_to"]}
    for v in plan.values():
        v["gap"] = v["rest"] - v.get("up_to", v.get("cut_before", 0))
    # fill up with the largest that fit
    first = (F.col("range") < F.col("cut_range")) | (
        (F.col("range") == F.col("cut_range"))
        & ((F.col("hash") < F.col("last_hash")) | ((F.col("hash") == F.col("last_hash")) & (F.col("size") <= F.col("last_size"))))
    )
    first = F.coalesce(first, F.lit(False))
    fits = with_plan(narrow, "cut_range", "last_hash", "last_size", "gap").filter(~first & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    fits = fits.groupBy("pattern", "hash", "size", "gap").agg(F.sum("size").alias("words")).filter(F.col("words") <= F.col("gap"))
    fits = fits.groupBy("pattern", F.floor(F.log2("words")).alias("class")).agg(F.max(F.struct("words", "hash", "size")).alias("x"))
    for r in sorted(fits.select("pattern", "x.*").collect(), key=lambda r: -r["words"]):  # a row for each pattern and power of two
        v = plan[tuple(r["pattern"])]
        if r["words"] <= v["gap"]:
            v["gap"] -= r["words"]
            v.setdefault("extra", []).append((r["hash"], r["size"]))
    # one more pass over the documents, without a shuffle
    every = docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), *facts).select("*", hash_range)
    every = with_plan(every, "pattern_size", "target", "whole", "cut_range", "last_hash", "last_size", "extra")
    chosen = first | F.coalesce(F.array_contains("extra", F.struct("hash", "size")), F.lit(False))
    taken = F.col("size") * (F.col("whole") + chosen.cast("long"))
    return every.select("row", "size", "pattern", F.coalesce("pattern_size", F.lit(0)).alias("pattern_size"), "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", how: Mix = Mix(), scratch: common.Scratch | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns that docs has."""
    chosen = mix(docs, text, how=how, scratch=scratch).filter("taken > 0")
    times = F.greatest(F.lit(1), (F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    return chosen.select("row", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("row.*")
