"""Cross-entropy difference of two matched n-gram models of words.

The models share one vocabulary: the words of all documents (between white space as the contracts have
it) and a text's end. One counts the documents of the target, the other all documents, each by every
n-gram up to ORDER; a word's probability is interpolated from the longest seen context downwards,

    P_k(w | context) = MIX * count(context w) / count(context) + (1 - MIX) * P_(k-1),

to the uniform one over the vocabulary. A document is scored without itself: its own occurrences are
taken from both models' counts, or a model of the whole corpus would know every document by heart.
Its score is the mean loss by the background less that by the target, in nats: the higher, the closer
to the target.

Nothing bounds the models: all n-grams of all documents count. Parts of the corpus send buckets their
distinct n-grams with two counts and get back how often other parts hold them (`exchange`); the driver
sees three sums. An n-gram is 40 bits of its hash beside its bucket, so two of them meet in one count
with a probability of 1e-6 or so at any size.

Defined results: null and empty texts, and those without words, have no tokens, losses and score 0;
other texts have their words and the end as tokens; without target documents the target model is
uniform; rows that repeat count as often as they stand, and a row leaves out only itself; a null id is
scored like others but is never of the target; very long texts are looked at whole, a piece at a time;
an empty table gives an empty table; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common, exchange
from vocalis.llm.exchange import by_number, pack, unpack

ORDER = 2
MIX = 0.7
#: Ids (of 8 bytes) up to which a list of target documents is broadcast.
MOST_BROADCAST = 2_000_000
#: Bytes that are hashed together.
PIECE = 1 << 19

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BEGIN, _END = _U(1), _U(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _B
    x = (x ^ (x >> _U(29))) * _A
    return x ^ (x >> _U(32))


def word_ids(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts (UTF-8), and how many words each has. A word's hash is a
    difference of sums of byte * A**place, shifted to place 0."""
    data = np.frombuffer(b"\n".join([*bodies, b""]), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    step = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    begin, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        z = max(a + 1, int(np.searchsorted(end, begin[a] + PIECE, "right")))
        low, high = begin[a], end[z - 1]
        power = np.cumprod(np.full(high - low, _A), dtype=np.uint64)
        sums = np.append(_U(0), np.cumsum((data[low:high].astype(np.uint64) + _U(1)) * power, dtype=np.uint64))
        back = np.cumprod(np.full(high - low, _INVERSE), dtype=np.uint64)
        x, y = begin[a:z] - low, end[a:z] - low
        out[a:z] = _mix((sums[y] - sums[x]) * back[x] + (y - x).astype(np.uint64))
        a = z
    starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    return out, np.diff(np.searchsorted(begin, starts))


class Grams:
    """The n-grams of a part's texts. Token t has key[k][t] for the n-gram of k + 1 tokens that it ends."""

    def __init__(self, bodies: list[bytes], order: int):
        words, n = word_ids(bodies)
        self.size = np.where(n > 0, n + 1, 0)  # the end is a token of texts that have words
        self.starts = np.cumsum(np.append(0, self.size))
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), self.size)
        token = np.full(self.starts[-1], _END)
        last = np.zeros(len(token), bool)
        last[self.starts[1:][self.size > 0] - 1] = True
        token[~last] = words
        place = np.arange(len(token)) - self.starts[:-1][self.doc]
        self.keys, held = [], _U(0)
        for k in range(order):
            back = np.where(place >= k, np.roll(token, k), _BEGIN)
            held = _mix(held * _A + back)
            self.keys.append((held & ~_U(3)) | _U(k))


def _code(n: np.ndarray, nt: np.ndarray) -> bytes:
    """Pairs of counts: a byte each, and in full where one is 15 or more."""
    big = np.flatnonzero((n >= 15) | (nt >= 15))
    return pack(np.minimum(n, 15).astype("u1") << 4 | np.minimum(nt, 15).astype("u1")) + pack(big.astype("<u4"), n[big].astype("<i8"), nt[big].astype("<i8"))


def _decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    (code,) = unpack(raw, "u1")
    n, nt = (code >> 4).astype(np.int64), (code & 15).astype(np.int64)
    at, big, big_t = unpack(raw[8 + len(code) :], "<u4", "<i8", "<i8")
    n[at], nt[at] = big, big_t
    return n, nt


def _counted(keys: np.ndarray, target: np.ndarray):
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, inverse, np.bincount(inverse, minlength=len(distinct)), np.bincount(inverse, target, len(distinct)).astype(np.int64)


class Counts:
    """A part's distinct n-grams of all orders, with their counts in the part. Order k's token t has
    the n-gram number at[k][t]."""

    def __init__(self, g: Grams, target: np.ndarray, n_buckets: int):
        some, self.at, base = [], [], 0
        for keys in g.keys:
            distinct, inverse, n, nt = _counted(keys, target)
            some.append((distinct, n, nt))
            self.at.append((inverse + base).astype(np.int32))
            base += len(distinct)
        self.keys, self.n, self.nt = (np.concatenate(x) for x in zip(*some))
        self.buckets = dict(by_number(((self.keys >> _U(8)) % _U(n_buckets)).astype(np.int64)))


COUNTS, WORDS, TOKENS, TARGET = 0, 1, 2, 3


def _flags(part: exchange.Part, g: Grams) -> np.ndarray:
    return np.array(part.extra[0], bool)[g.doc]


def _ask(n_buckets: int, order: int):
    def run(part):
        g = Grams(part.bodies, order)
        c, rows = Counts(g, _flags(part, g), n_buckets), []
        for b, at in c.buckets.items():
            k = c.keys[at]
            rows.append((b, part.number, pack((k >> _U(32)).astype("<u4"), (k & _U(255)).astype("u1")) + _code(c.n[at], c.nt[at])))
        for a in range(0, len(rows), 500):
            yield exchange.batch(rows[a : a + 500], bucket=pa.int64(), part=pa.int64(), body=pa.binary())

    return run


def _tell(bucket: int, parts: list[int], bodies: list[bytes]):
    """To each part, how often others hold its n-grams; and the bucket's share of three sums."""
    keys, n, nt = [], [], []
    for raw in bodies:
        high, low = unpack(raw, "<u4", "u1")
        keys.append(high.astype(np.uint64) << _U(8) | low)
        a, b = _decode(raw[8 + 5 * len(high) :])
        n.append(a)
        nt.append(b)
    ends = np.cumsum([len(k) for k in keys])
    keys, n, nt = (np.concatenate(x) for x in (keys, n, nt))
    distinct, inverse = np.unique(keys, return_inverse=True)
    all_n, all_t = (np.bincount(inverse, x, len(distinct)).astype(np.int64) for x in (n, nt))
    for p, a, b in zip(parts, [0, *ends], ends):
        others, others_t = all_n[inverse[a:b]] - n[a:b], all_t[inverse[a:b]] - nt[a:b]
        if others.any():
            yield p, COUNTS, _code(others, others_t)
    one = (distinct & _U(3)) == _U(0)
    return [(WORDS, int(one.sum())), (TOKENS, int(all_n[one].sum())), (TARGET, int(all_t[one].sum()))]


def _score(n_buckets: int, order: int, mix: float, words: int, tokens: int, in_target: int):
    def run(part):
        g = Grams(part.bodies, order)
        target = _flags(part, g)
        c = Counts(g, target, n_buckets)
        for b, raw in part.answers.get(COUNTS, {}).items():
            others, others_t = _decode(raw)
            c.n[c.buckets[b]] += others
            c.nt[c.buckets[b]] += others_t
        p = {m: np.full(len(g.doc), 1 / max(words, 1)) for m in ("all", "target")}
        # a word's context: all tokens, then the n-gram that ended one token before; a text's first token has none
        own = g.size[g.doc]
        context = {"all": tokens - own, "target": in_target - own * target}
        first = np.zeros(len(g.doc), bool)
        first[g.starts[:-1][g.size > 0]] = True
        salt = _mix(g.doc.astype(np.uint64) + _A)
        for at, keys in zip(c.at, g.keys):
            _, mine, times = np.unique(_mix(keys ^ salt), return_inverse=True, return_counts=True)
            own = times[mine]  # in this document
            del mine, times
            count = {"all": c.n[at] - own, "target": c.nt[at] - own * target}
            for m in p:
                p[m] = np.where(context[m] > 0, mix * count[m] / np.maximum(context[m], 1) + (1 - mix) * p[m], p[m])
                context[m] = np.where(first, 0, np.roll(count[m], 1))
        mean = []
        for m in ("target", "all"):
            loss = np.append(0.0, np.cumsum(-np.log(p[m])))
            mean.append((loss[g.starts[1:]] - loss[g.starts[:-1]]) / np.maximum(g.size, 1))
        ids = pa.array([None if no else int(i) for i, no in zip(part.ids, part.extra[1])], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(g.size, pa.int64()), *map(pa.array, mean), pa.array(mean[1] - mean[0])], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return run


def listed(docs: DataFrame, ids: DataFrame, scratch: common.Scratch, id_col: str = "doc_id") -> DataFrame:
    """docs with a boolean `_listed`: whether the id is in ids (one column). A short list travels to
    the documents; a long one is joined."""
    ids = scratch.write(ids.toDF("_of").filter("_of is not null").distinct(), "listed")
    small = ids.count() <= MOST_BROADCAST
    ids = ids.withColumn("_listed", F.lit(True))
    both = docs.join(F.broadcast(ids) if small else ids, F.col(id_col) == F.col("_of"), "left")
    return both.select(*(F.col(c) for c in docs.columns), F.coalesce("_listed", F.lit(False)).alias("_listed"))


def score(
    docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, mix: float = MIX, part_bytes: int = exchange.PART_BYTES, scratch: common.Scratch | None = None
) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (means) and score of every document. ids: one
    column, the ids of the target's documents."""
    scratch = common.scope(docs, scratch)
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = exchange.n_parts_of(docs, "_text", part_bytes)
    rows = listed(docs, ids, scratch, "_id").select(
        F.pmod(F.xxhash64("_id", "_text"), F.lit(n)).alias("part"), F.lit(99).alias("kind"), F.coalesce(F.col("_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("_text").alias("hash"),
        F.lit(0).cast("long").alias("bucket"), F.encode("_text", "UTF-8").alias("body"), "_listed", F.col("_id").isNull().alias("_no_id"),
    )
    asked = exchange.by_part(rows, _ask(n, order), exchange.MESSAGE, "_listed", "_no_id")
    counts = scratch.write(exchange.by_bucket(asked, _tell), "counts")
    sums = {r["kind"]: r["n"] for r in counts.filter("part < 0").groupBy("kind").agg(F.sum("bucket").alias("n")).collect()}  # three rows
    scoring = _score(n, order, mix, sums.get(WORDS, 0), sums.get(TOKENS, 0), sums.get(TARGET, 0))
    schema = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
    return exchange.by_part(exchange.with_answers(rows, counts.filter("part >= 0")), scoring, schema, "_listed", "_no_id")
