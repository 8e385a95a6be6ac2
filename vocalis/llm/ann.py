"""Approximate nearest neighbours by 2-stable projections, kd-trees and a chi-square stopping test.

Vectors are lifted by one component so that a larger inner product is a smaller distance, and
projected to M dimensions by one seeded Gaussian matrix. The projected distance of two vectors over
their true one, squared, follows a chi-square law with M degrees of freedom. A kd-tree over projected
points gives a query its leaves in the order of projected distance; in a leaf, the points within the
projected distance at which the test holds are verified in full, and the query ends at the leaf where
the nearest point may lie beyond it: a vector nearer than the k-th found lies beyond with probability
1 - STOP at most. That bounds the expected share of neighbours missed; no candidate is capped.

The upper levels of the tree are fitted on a bounded sample (SAMPLE rows, by hash of the id) and give
cells; every row is indexed. A query first searches its own cell; the distance of its k-th neighbour
there tells, by the same test on the cells' boxes, which other cells it visits. Cells are cut into shards
of SHARD vectors, one task each, so that a cell with a third of all vectors (one vector, many times) is
many tasks. A task holds one shard and lets the queries that visit it stream by, CHUNK at a time, so a
vector travels once for each of the two visits, however many queries there are. Cells are at most
SAMPLE / 8, whatever the input. What a later shard returns beats the k-th already known.

How much is verified depends on the data: the test can end early only where neighbours are nearer
than the rest. The README has measured shares and recall.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or have
another dimension than most take no part; a null id takes no part; repeated ids are rows of their own
but never neighbours of their own id, and a repeated query id asks with the least of its vectors (as
bytes); ties go to the smaller id; fewer candidates than k are all returned; an empty table gives an
empty table; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm import common

M = 32
STOP = 0.92
SAMPLE = 65_536
SHARD = 8_192
LEAF = 512
CHUNK = 512
#: Scores that differ by less are ordered by id while a search goes on; the end is exact.
GRID = 1e-9


def chi_square(x: float, m: int) -> float:
    """The law's distribution function for even m."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stopping_ratio(m: int = M, p: float = STOP) -> float:
    """The squared ratio of projected to true distance at which the test holds."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def fit_cells(points: np.ndarray, n_cells: int) -> list[tuple[int, float, int, int]]:
    """A tree as (dimension, cut, left, right); a leaf is (-1, 0, cell, 0)."""
    tree, n = [], 0

    def grow(rows: np.ndarray, cells: int) -> int:
        nonlocal n
        at = len(tree)
        tree.append(None)
        if cells > 1 and len(rows) > 1:
            some = points[rows]
            k = int(np.argmax(some.max(0) - some.min(0)))
            cut = float(np.median(some[:, k]))
            left = some[:, k] < cut
            if left.any() and not left.all():
                tree[at] = (k, cut, grow(rows[left], cells // 2), grow(rows[~left], cells - cells // 2))
                return at
        tree[at] = (-1, 0.0, n, 0)
        n += 1
        return at

    grow(np.arange(len(points)), n_cells)
    return tree


def cell_of(points: np.ndarray, tree) -> np.ndarray:
    out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        k, cut, a, b = tree[at]
        if k < 0:
            out[rows] = a
        elif len(rows):
            left = points[rows, k] < cut
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


class Shard:
    """Vectors with a kd-tree over their projections: leaf l has rows edges[l]:edges[l + 1]."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, matrix: np.ndarray, top: float):
        points = project(v, matrix, top)
        todo, leaves = [np.arange(len(points))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            some = points[rows]
            k = int(np.argmax(some.max(0) - some.min(0)))
            order = np.argsort(some[:, k], kind="stable")
            todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
        order = np.concatenate(leaves)
        self.edges = np.cumsum([0, *map(len, leaves)])
        self.ids, self.v, self.points = ids[order], v[order], points[order]
        self.square = (self.points * self.points).sum(1)
        self.low = np.minimum.reduceat(self.points, self.edges[:-1])
        self.high = np.maximum.reduceat(self.points, self.edges[:-1])

    def search(self, asks: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, matrix: np.ndarray, top: float, stop: float):
        """Query, row and score of the best k for each query that reach its kth; how many pairs were verified."""
        kth, aim, each = kth.copy(), q @ matrix[:-1], np.arange(len(q))
        base, aim_square = (q * q).sum(1) + top * top, (aim * aim).sum(1)
        near = box_distance(aim, self.low, self.high)
        order = np.argsort(near, axis=1, kind="stable")
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        verified = 0
        for turn in range(order.shape[1]):
            leaf_of = order[:, turn]
            bound = stop * np.maximum(base - 2 * kth, 0)
            away = near[each, leaf_of]
            live = (away < bound) | (away == 0)
            if not live.any():
                break
            found = [best]
            for leaf in np.unique(leaf_of[live]):
                rows, a, z = np.flatnonzero(live & (leaf_of == leaf)), self.edges[leaf], self.edges[leaf + 1]
                distance = aim_square[rows, None] + self.square[a:z] - 2 * (aim[rows] @ self.points[a:z].T)
                within = (distance <= bound[rows, None] * (1 + 1e-9)) & (self.ids[a:z] != asks[rows, None])
                need = np.flatnonzero(within.any(0))
                verified += int(within.sum())
                score = np.where(within[:, need], q[rows] @ self.v[a + need].T, -np.inf)  # a block's products together
                i, j = np.nonzero((score >= kth[rows, None] - GRID) & (score > -np.inf))
                found.append((rows[i], a + need[j], score[i, j]))
            r, row, s = (np.concatenate(x) for x in zip(*found))
            at = np.lexsort((self.ids[row], -np.round(s / GRID), r))
            r, row, s = r[at], row[at], s[at]
            first = np.searchsorted(r, each)
            rank = np.arange(len(r)) - first[r]
            keep = rank < k + 4
            best = (r[keep], row[keep], s[keep])
            last = rank == k - 1
            kth[r[last]] = np.maximum(kth[r[last]], s[last])
        r, row, _ = best
        s = np.concatenate([np.empty(0), *((self.v[row[a : a + 10_000]] * q[r[a : a + 10_000]]).sum(1) for a in range(0, len(r), 10_000))])
        at = np.lexsort((self.ids[row], -s, r))
        r, row, s = r[at], row[at], s[at]
        keep = np.arange(len(r)) - np.searchsorted(r, each)[r] < k if len(r) else np.empty(0, bool)
        return r[keep], row[keep], s[keep], verified


def box_distance(aim: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each aim to each box."""
    out = np.zeros((len(aim), len(low)))
    for d in range(aim.shape[1]):
        x = aim[:, d, None]
        gap = np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0)
        out += gap * gap
    return out


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, d)


def _visits(k: int, matrix: np.ndarray, top: float, stop: float):
    """Rows (cell, shard, kind, id, v, kth) in this order: a shard's vectors (kind 0), then its queries."""
    d = len(matrix) - 1

    def run(batches):
        key, ids, vs, shard = None, [], [], None
        for batch in batches:
            cell, part, kind = (batch.column(c).to_numpy() for c in range(3))
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *change], [*change, batch.num_rows]):
                if a == z:
                    continue
                if (cell[a], part[a]) != key:
                    key, ids, vs, shard = (cell[a], part[a]), [], [], None
                some = batch.slice(a, z - a)
                if kind[a] == 0:
                    ids.append(some.column(3).to_numpy())
                    vs.append(_vectors(some.column(4), d))
                    continue
                if not ids:
                    continue
                shard = shard or Shard(np.concatenate(ids), np.concatenate(vs), matrix, top)
                for at in range(0, some.num_rows, CHUNK):
                    asks = some.slice(at, CHUNK)
                    qid = asks.column(3).to_numpy()
                    r, row, s, verified = shard.search(qid, _vectors(asks.column(4), d), asks.column(5).to_numpy(), k, matrix, top, stop)
                    share = np.zeros(len(r), np.int64)
                    if len(r):
                        share[0] = verified
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[r], shard.ids[row], s, share)], names=["query_id", "vec_id", "score", "verified"])

    return run


def project(v: np.ndarray, matrix: np.ndarray, top: float) -> np.ndarray:
    """Lift so that the largest inner product is the nearest, then project."""
    lift = np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))
    return v @ matrix[:-1] + lift[:, None] * matrix[-1]


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, seed: int = 11, scratch: common.Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found with the largest inner product for each query row."""
    found = candidates(vectors, is_query, id_col, vector, k, seed, scratch)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def candidates(vectors: DataFrame, is_query: Column, id_col: str, vector: str, k: int, seed: int, scratch: common.Scratch | None = None) -> DataFrame | None:
    """query_id, vec_id, score: the best of each visit, with how many pairs it verified (on one of the
    rows of its chunk). None without vectors."""
    spark, scratch = vectors.sparkSession, common.scope(vectors, scratch)
    common.ship(spark)
    x = F.col(vector).cast("array<double>")
    fine = (
        F.col(id_col).isNotNull()
        & (F.size(x) > 0)
        & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        & F.exists(x, lambda c: c != 0)
    )
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return None
    d = dims["d"]

    def packed(frames):
        for f in frames:
            v = np.stack(f["x"].to_list()).astype("<f8")
            yield pd.DataFrame({"id": f["id"], "asks": f["asks"], "v": [a.tobytes() for a in v], "norm": (v * v).sum(1)})

    points = scratch.write(rows.filter(F.size("x") == d).mapInPandas(packed, "id long, asks boolean, v binary, norm double"), "vectors")
    total = points.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).first()
    top, n = math.sqrt(total["top"]), total["n"]
    matrix = np.random.default_rng(seed).standard_normal((d + 1, M))
    some = points.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toPandas()["v"]  # SAMPLE rows at most
    known = project(np.frombuffer(b"".join(some), "<f8").reshape(len(some), d), matrix, top)
    tree = fit_cells(known, max(1, min(-(-n // SHARD), len(known) // 8)))

    def place(frames):
        for f in frames:
            v = np.frombuffer(b"".join(f["v"]), "<f8").reshape(len(f), d)
            y = project(v, matrix, top)
            yield pd.DataFrame({"id": f["id"], "asks": f["asks"], "v": f["v"], "cell": cell_of(y, tree), "home": cell_of(v @ matrix[:-1], tree), "y": list(y)})

    placed = scratch.write(points.mapInPandas(place, "id long, asks boolean, v binary, cell long, home long, y array<double>"), "cells")
    boxes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.min(F.get("y", i)) for i in range(M))).alias("low"),
        F.array(*(F.max(F.get("y", i)) for i in range(M))).alias("high"),
    )
    boxes = boxes.orderBy("cell").collect()  # SAMPLE / 8 rows at most
    cells, low, high = np.array([b["cell"] for b in boxes]), np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    shards = F.broadcast(spark.createDataFrame([(b["cell"], -(-b["n"] // SHARD)) for b in boxes], "cell long, shards int"))
    stop = stopping_ratio()
    held = placed.join(shards, "cell").select(
        "cell", F.pmod(F.xxhash64("id", "v"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("kth")
    )

    def visit(asked: DataFrame) -> DataFrame:
        """asked: cell, id, v, kth (the score to reach)."""
        who = asked.join(shards, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "v", "kth")
        both = held.unionByName(who).repartition("cell", "shard").sortWithinPartitions("cell", "shard", "kind", "id")
        return both.mapInArrow(_visits(k, matrix, top, stop), "query_id long, vec_id long, score double, verified long")

    queries = scratch.write(placed.filter("asks").groupBy("id").agg(F.min(F.struct("v", "home")).alias("x")).select("id", "x.*"), "queries")
    first = scratch.write(visit(queries.select(F.col("home").alias("cell"), "id", "v", F.lit(-math.inf).alias("kth"))), "first")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))

    def further(frames):
        for whole in frames:
            for a in range(0, len(whole), CHUNK):
                f = whole.iloc[a : a + CHUNK]
                q = np.frombuffer(b"".join(f["v"]), "<f8").reshape(len(f), d)
                reach = f["kth"].fillna(-math.inf).to_numpy()
                bound = stop * np.maximum((q * q).sum(1) + top * top - 2 * reach, 0)
                near = box_distance(q @ matrix[:-1], low, high)
                i, j = np.nonzero(((near < bound[:, None]) | (near == 0)) & (cells != f["home"].to_numpy()[:, None]))
                for b in range(0, len(i), 4096):
                    r = i[b : b + 4096]
                    yield pd.DataFrame({"cell": cells[j[b : b + 4096]], "id": f["id"].to_numpy()[r], "v": f["v"].to_numpy()[r], "kth": reach[r]})

    onward = queries.join(kth, "id", "left").mapInPandas(further, "cell long, id long, v binary, kth double")
    return first.unionByName(visit(scratch.write(onward, "onward")))
