"""Packing by cutting stock: column generation over length classes.

A document's ids are cut into full sequences and one rest. Lengths fall into classes, each named by the
length it makes room for: every length is its own class where CLASSES suffice, else short and frequent
lengths are, and others are rounded up by a 64th at most. On the driver, from the histogram of lengths
alone (a row for each length of a sequence at most, whatever the corpus), the linear program of
patterns is solved by the revised simplex method; an unbounded knapsack over the dual prices supplies
columns. Patterns are rounded down, the pieces left over (a few for each pattern) are packed first fit
decreasing, and pieces take the slots of their class by rank. Ranks come from counts per class and
salt, so that a class with a third of all pieces is ranked by many tasks.

Defined results: null text encodes to the end id alone; repeated rows are packed as often as they
stand, and equal pieces rank among each other in any order; very long texts are encoded whole; an empty
table gives no row; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm import common, tokens

#: Lengths that get a class of their own, by how many pieces have them.
CLASSES = 320
CHUNK = 256
#: Pieces that one rank task may hold.
PER_SALT = 8_192


def classes(demand: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The class of each length: demand[k] pieces have k + 1 ids."""
    lengths = np.arange(1, len(demand) + 1)
    if (demand > 0).sum() <= most:
        return lengths
    step = np.maximum(1, lengths // 64)
    own = (lengths % step == 0) | (lengths == len(demand))
    own[np.argsort(-demand, kind="stable")[: most // 4]] = True
    edges = lengths[own]
    return edges[np.searchsorted(edges, lengths)]


def _price(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes (ascending) in capacity: unbounded knapsack by capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        gain = value[: fits[c]] + best[c - sizes[: fits[c]]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], took[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if took[c] >= 0:
            counts[took[c]] += 1
            c -= sizes[took[c]]
        else:
            c -= 1
    return best[capacity], counts


def first_fit(left: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for left[k] pieces of sizes[k] by first fit decreasing, like ones at once."""
    left, used = left.astype(int).copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), int), capacity
        while room > 0:
            some = np.flatnonzero(left[: np.searchsorted(sizes, room, "right")])
            if not len(some):
                break
            k = some[-1]
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k] += n
            left[k] -= n
            room -= n * int(sizes[k])
        on = pattern > 0
        times = 1 + int((left[on] // pattern[on]).min())
        used.append((pattern, times))
        left -= (times - 1) * pattern
    return used


def patterns(need: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = 5e-4, most: int = 200) -> list[tuple[np.ndarray, int]]:
    """need[k] pieces of sizes[k] (ascending) into stock of size capacity. Patterns (pieces of each size)
    and how often each is used; together they have a slot for every piece. A fixed point of the input.

    The linear program begins with the columns of a first-fit solution; the best of them enters while
    one improves on the present dual prices, then the knapsack supplies new ones, until the sum is
    within gap of a lower bound (Farley's), or most knapsacks were solved."""
    if not len(sizes):
        return []
    need, m = need.astype(float), len(sizes)
    # told apart a little, so that no two basic columns run out together and the method can't go in circles
    goal = need * (1 + 1e-7 * np.arange(1, m + 1) / m) + 1e-6 * np.random.default_rng(0).random(m)
    pool = np.array([p for p, _ in first_fit(need, sizes, capacity)], float)
    columns, cost = np.diag((capacity // sizes).astype(float)), np.ones(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ goal
    bound, solved, turn = float(sizes @ need) / capacity, 0, 0
    while cost @ x > bound * (1 + gap) and solved < most and turn < 20 * (most + m):
        turn += 1
        dual = cost @ inverse
        if dual.min() < -1e-9:  # a piece too many costs nothing
            k = int(np.argmin(dual))
            enter, price = np.zeros(m), 0.0
            enter[k] = -1.0
        else:
            dual, price = np.maximum(dual, 0), 1.0
            worths = pool @ dual
            k = int(np.argmax(worths))
            enter = pool[k]
            if worths[k] <= 1 + 1e-9:
                solved += 1
                worth, counts = _price(dual, sizes, capacity)
                bound = max(bound, float(dual @ need) / worth)
                if worth <= 1 + 1e-9:
                    break
                enter = counts.astype(float)
                pool = np.vstack([pool, enter])
        step = inverse @ enter
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        columns[:, leave], cost[leave] = enter, price
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        x = np.maximum(inverse @ goal, 0)
    used, left = [], need.astype(int)
    for k in np.argsort(-x * cost, kind="stable"):
        if not cost[k]:
            continue
        pattern = columns[:, k].astype(int)
        on = pattern > 0
        times = int(min(np.floor(x[k] + 1e-6), (left[on] // pattern[on]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= times * pattern
    return used + first_fit(left, sizes, capacity)


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text: str, length: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut at multiples of length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                some, rows = batch.slice(a, CHUNK), []
                for doc, raw in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, length):
                        piece = raw[4 * s : 4 * (s + length)]
                        rows.append((doc, s, len(piece) // 4, tokens.crc32(piece), n))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    scratch = common.scope(docs, scratch)
    common.ship(docs.sparkSession)
    cut = scratch.write(pieces(docs, tokenizer, id_col, text, length, end_id), "pieces")
    demand = np.zeros(length, int)
    for r in cut.groupBy("length").count().collect():  # a row for each length
        demand[r["length"] - 1] = r["count"]
    of = classes(demand)
    need = np.bincount(of, demand, length + 1).astype(int)
    sizes = np.flatnonzero(need)
    salts = max(1, int(demand.sum()) // PER_SALT)
    used = patterns(need[sizes], sizes, length)
    names = docs.sparkSession.createDataFrame(list(zip(range(1, length + 1), of.tolist())), "length long, size int")
    cut = cut.join(F.broadcast(names), "length")

    # slots of each class: from which rank on, how many in each sequence, of which pattern
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base, filled = 0, dict.fromkeys(range(len(sizes)), 0)
    for pattern, times in used:
        place = 0
        for k in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[k])
            slots.setdefault(int(sizes[k]), []).append((filled[k], n, base, place))
            filled[k] += n * times
            place += n
        base += times
    held = {k: np.array(v, np.int64) for k, v in slots.items()}

    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.join(counts, ["size", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)

    def place(frames):
        for frame in frames:
            rank, size = frame["rank"].to_numpy(), frame["size"].to_numpy()
            sequence, slot = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for k in np.unique(size):
                at, of = np.flatnonzero(size == k), held[int(k)]
                first, n, begin, inside = of[np.searchsorted(of[:, 0], rank[at], "right") - 1].T
                sequence[at] = begin + (rank[at] - first) // n
                slot[at] = inside + (rank[at] - first) % n
            yield pd.DataFrame({**{c: frame[c] for c in KEPT}, "sequence_id": sequence, "slot": slot})

    placed = ranked.select(*KEPT, "size", "rank").mapInPandas(place, ", ".join(f"{c} long" for c in (*KEPT, "sequence_id", "slot")))
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*KEPT, "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset"))


KEPT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
