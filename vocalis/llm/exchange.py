"""Questions about keys that are asked by whole parts of a corpus and answered by buckets of keys.

Documents are dealt to parts of about PART_BYTES by a hash of their id. A part looks at its documents
together, so what many of them share is combined before it travels: it sends each bucket one message
with its distinct keys, and gets back one message with an answer for each key in the order sent. Parts
and buckets grow in number with the corpus and keep their size; a key that every document holds is
sent once by each part.

A part is computed again where its answers are used; all it does follows from its rows in their order
(id, hash of the text), so a part that a lost executor had is made again the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 4 << 20
#: Rows that become Python objects together.
CHUNK = 256
MESSAGE = "bucket long, part long, body binary"
ANSWER = "part long, kind int, bucket long, body binary"
U = np.uint64


@dataclass
class Part:
    number: int
    ids: np.ndarray
    hashes: np.ndarray
    bodies: list[bytes]
    #: kind of answer to bucket to message
    answers: dict[int, dict[int, bytes]]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.bodies)])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one message."""
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def by_number(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number with where it stands, in order."""
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(numbers[order[a]]), order[a:b]


def batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))


def rows_of(docs: DataFrame, id_col: str, text: str, n_parts: int, *extra: str) -> DataFrame:
    """part, kind, id, hash, bucket, body and extra columns of each document with an id and a text."""
    base = docs.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    return base.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_parts)).alias("part"), F.lit(99).alias("kind"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"),
        F.lit(0).cast("long").alias("bucket"), F.encode(F.col(text), "UTF-8").alias("body"), *extra,
    )


def n_parts_of(docs: DataFrame, text: str, part_bytes: int) -> int:
    return max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // part_bytes))


def with_answers(rows: DataFrame, *answers: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast("long")
    for a in answers:
        rows = rows.unionByName(a.select("part", "kind", nothing.alias("id"), nothing.alias("hash"), "bucket", "body"), allowMissingColumns=True)
    return rows


def _chunks(batches):
    for some in batches:
        for a in range(0, some.num_rows, CHUNK):
            yield some.slice(a, CHUNK)


def by_part(rows: DataFrame, run: Callable[[Part], Iterator[pa.RecordBatch]], schema: str, *extra: str) -> DataFrame:
    """run over each part; extra columns are given as lists in Part.extra."""

    def over(batches):
        part, held = None, []
        for some in _chunks(batches):
            for p, kind, i, h, bucket, body, *more in zip(*(some.column(k).to_pylist() for k in range(some.num_columns))):
                if part is None or p != part.number:
                    if part is not None:
                        yield from _done(part, held, run)
                    part, held = Part(p, None, None, [], {}), []
                if kind < 99:
                    part.answers.setdefault(kind, {})[bucket] = body
                else:
                    held.append((i, h, more))
                    part.bodies.append(body)
        if part is not None:
            yield from _done(part, held, run)

    columns = ["part", "kind", "id", "hash", "bucket", "body", *extra]
    return rows.repartition("part").sortWithinPartitions("part", "kind", "id", "hash").select(*columns).mapInArrow(over, schema)


def _done(part: Part, held: list, run) -> Iterator[pa.RecordBatch]:
    part.ids, part.hashes = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
    part.extra = [list(c) for c in zip(*(x[2] for x in held))]
    yield from run(part)


def by_bucket(messages: DataFrame, run: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """run(bucket, parts, messages) yields (part, kind, message): the answers, as a table of ANSWER. The
    sums (kind, n) that it returns are rows of part -1, with n for the bucket."""

    def over(batches):
        def done():
            rows, told = [], run(bucket, parts, bodies)
            sums = yield_all(told, lambda p, kind, body: rows.append((p, kind, bucket, body)))
            rows += [(-1, kind, n, b"") for kind, n in sums]
            if rows:
                yield batch(rows, part=pa.int64(), kind=pa.int32(), bucket=pa.int64(), body=pa.binary())

        bucket, parts, bodies = None, [], []
        for some in _chunks(batches):
            for b, p, body in zip(*(some.column(k).to_pylist() for k in range(3))):
                if b != bucket:
                    if bodies:
                        yield from done()
                    bucket, parts, bodies = b, [], []
                parts.append(p)
                bodies.append(body)
        if bodies:
            yield from done()

    return messages.repartition("bucket").sortWithinPartitions("bucket", "part").mapInArrow(over, ANSWER)


def yield_all(told, take) -> list[tuple[int, int]]:
    """Give all that a generator yields to take; what it returns, or nothing."""
    while True:
        try:
            take(*next(told))
        except StopIteration as end:
            return end.value or []


def messages(part: int, buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(b, part, pack(*(a[at] for a in arrays))) for b, at in by_number(buckets)]
    if rows:
        yield batch(rows, bucket=pa.int64(), part=pa.int64(), body=pa.binary())
