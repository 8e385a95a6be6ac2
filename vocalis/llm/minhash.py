"""Near duplicates by MinHash, sequential Bayesian pruning and exact verification.

1. Every document gives its set of hashed word shingles, the set's digest, a signature and the keys
   of its bands. Documents with one set are a class; its smallest id stands for it from here on.
2. Within a band's bucket the member with the most company is the hub; the others are compared with
   it. A pair's signatures are compared in batches; after each one the pair is dropped if the posterior
   probability that its similarity reaches the threshold is below MISS (uniform prior: a binomial
   tail). Survivors are verified on the full shingle sets of their texts, with whole numbers.
3. Buckets whose members aren't of one component by then hang together in families. What is not of a
   family's largest component is compared with the whole family in the same way, so a family costs its
   size times its rest, not its square. Both are dealt in blocks of BLOCK documents: a task first sees
   ids and signatures alone, and texts travel only to the tasks, and of the documents, that have a likely
   pair. There, likeliest pairs first, a link is given only where it joins components: no pairs are
   written, and a large family is many tasks.
4. Links give components, by min-label stars over tables.

Hubs come from aggregates that are combined before the shuffle; pairs and texts come from ordinary
joins whose hot keys Spark splits at run time. Band parameters follow from the threshold so that a
pair at the threshold is missed by all bands with probability BAND_MISS.

Defined results: texts without words, and null texts, have no set and are linked with nothing; rows
with one id are one node, whose text is, where they differ, the one with the least digest; a null id
stands alone; an empty table gives an empty table; other columns are not read, so their names can't
clash. Very long texts are used whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common
from vocalis.llm.components import components

K = 144
BATCH = 24
BAND_MISS = 2e-5
MISS = 1e-6
#: Ids (of 8 bytes) up to which the list of documents that pairs can need is broadcast.
MOST_BROADCAST = 2_000_000
#: Documents in a block of a family.
BLOCK = 256
CHUNK = 256
MEMO = 400_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_hashes: dict[str, int] = {}


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    num: int = 80
    den: int = 100

    @property
    def band_rows(self) -> int:
        t, r = self.num / self.den, 1
        while r < 16 and (1 - t ** (r + 1)) ** (K // (r + 1)) <= BAND_MISS:
            r += 1
        return r


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > MEMO:
        _hashes.clear()
    try:
        h = np.array([_hashes[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in _hashes:
                _hashes[w] = _word_hash(w)
        h = np.array([_hashes[w] for w in words], np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


_A = np.random.default_rng(20240607).integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(7).integers(0, 1 << 32, K, dtype=np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), 2048):
        x = low[a : a + 2048] * _A[:, None]
        x += _B[:, None]
        x ^= x >> np.uint32(15)
        np.minimum(out, (x * np.uint32(0x85EBCA6B)).min(1), out=out)
    return out


def _describe(near: Near):
    r = near.band_rows
    bands = K // r

    def run(batches):
        mix = np.random.default_rng(99).integers(0, 1 << 63, (bands, r), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                n, digest, sig, keys = [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingles(text, near.shingle)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None)
                        sig.append(None)
                        keys.append(None)
                        continue
                    g = signature(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(g.tobytes())
                    k = (g[: bands * r].reshape(bands, r).astype(np.uint64) + np.uint64(1)) * mix
                    k ^= k >> np.uint64(31)
                    keys.append((k.sum(1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), some.column(2), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "digest", "hash", "sig", "keys"],
                )

    return run


def least_matches(n: int, t: float, miss: float = MISS) -> int:
    """The fewest matches of n hashes at which the posterior P(similarity >= t) is miss or more."""
    tail, term = 0.0, (1 - t) ** (n + 1)  # P(Bin(n + 1, t) <= m)
    for m in range(n + 1):
        tail += term
        if tail >= miss:
            return m
        term *= (n + 1 - m) / (m + 1) * t / (1 - t)
    return n


def _prune(near: Near):
    t = near.num / near.den
    steps = [(n, least_matches(n, t)) for n in range(BATCH, K + 1, BATCH)]

    def run(batches):
        for batch in batches:
            live = np.arange(batch.num_rows)
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, K) for c in ("sig_a", "sig_b"))
            matched = np.zeros(batch.num_rows, int)
            for n, least in steps:
                some = slice(n - BATCH, n)
                matched[live] += (a[live, some] == b[live, some]).sum(1)
                live = live[matched[live] >= least]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return run


def _verify(near: Near):
    def run(batches):
        last, known = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, known = a[i], shingles(ta[i], near.shingle)
                other = shingles(tb[i], near.shingle)
                both = len(np.intersect1d(known, other, assume_unique=True))
                if near.den * both >= near.num * (len(known) + len(other) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _likely(sigs: np.ndarray, component: np.ndarray, asks: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row that asks and one that doesn't, of different components, that pass all batches:
    matches, first and second row."""
    found, others = [], np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        live = others[component[others] != component[i]]
        matched = np.zeros(len(live), int)
        for n, least in steps:
            matched += (sigs[live, n - BATCH : n] == sigs[i, n - BATCH : n]).sum(1)
            on = matched >= least
            live, matched = live[on], matched[on]
            if not len(live):
                break
        if len(live):
            found.append((matched, np.full(len(live), i), live))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 3


def _grouped(near: Near, names: list[str], group):
    """Rows (family, x, y, asks, id, of, sig, ...) in order of the first three, a task after the other,
    through group(key, rows, likely pairs)."""
    t = near.num / near.den
    steps = [(n, least_matches(n, t)) for n in range(BATCH, K + 1, BATCH)]

    def run(batches):
        key, rows = None, []

        def done():
            number = {c: k for k, c in enumerate(dict.fromkeys(r[2] for r in rows))}
            component = np.array([number[r[2]] for r in rows])
            sigs = np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(-1, K)
            found = list(group(key, rows, component, _likely(sigs, component, np.array([r[0] for r in rows], bool), steps)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)

        for batch in batches:
            for f, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, x, y) != key:
                    if rows:
                        yield from done()
                    key, rows = (f, x, y), []
                rows.append(row)
        if rows:
            yield from done()

    return run


def _needed(near: Near):
    """Which rows of a task have a likely pair."""

    def group(key, rows, component, likely):
        for k in np.unique(np.concatenate(likely[1:])).tolist():
            yield (*key, rows[k][0], rows[k][1])

    return _grouped(near, ["family", "x", "y", "asks", "id"], group)


def _compare(near: Near):
    """Links between components, on full sets. A row's last value is its text."""

    def group(key, rows, component, likely):
        parent = list(range(len(rows)))

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        sets: dict[int, np.ndarray] = {}
        for at in np.lexsort((likely[2], likely[1], -likely[0])).tolist():
            i, j = int(likely[1][at]), int(likely[2][at])
            a, b = root(component[i]), root(component[j])
            if a == b:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingles(rows[k][4], near.shingle)
            u, v = sets[i], sets[j]
            if near.num * max(len(u), len(v)) > near.den * min(len(u), len(v)):
                continue
            both = len(np.intersect1d(u, v, assume_unique=True))
            if near.den * both >= near.num * (len(u) + len(v) - both):
                parent[max(a, b)] = min(a, b)
                yield rows[i][1], rows[j][1]

    return _grouped(near, ["a", "b"], group)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", near: Near = Near(), scratch: common.Scratch | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    scratch = common.scope(docs, scratch)
    common.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    described = scratch.write(
        texts.mapInArrow(_describe(near), "id long, n_shingles long, digest binary, hash long, sig binary, keys array<long>"), "minhash"
    )
    classes = described.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    classes = scratch.write(classes, "classes")
    reps = described.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")

    banded = reps.select("id", F.explode("keys").alias("key"))
    company = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = banded.join(company, "key")
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = scratch.write(members.select("key", "id").join(weight, "id"), "members")
    # the signatures and texts that pairs can need
    named = scratch.write(members.select("id").distinct(), "named")
    if named.count() <= MOST_BROADCAST:  # then texts needn't be shuffled to find theirs
        named = F.broadcast(named)
    chosen = reps.join(named, "id", "left_semi").groupBy("id").agg(F.min(F.struct("digest", "hash", "sig")).alias("x")).select("id", "x.hash", "x.sig")
    held = texts.join(named, "id", "left_semi").join(chosen, ["id", "hash"]).groupBy("id").agg(F.first("text").alias("text"), F.first("sig").alias("sig"))
    held = scratch.write(held, "held")  # rows of one id that are left are equal

    hub = members.groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    spokes = members.join(hub, "key").filter("id <> hub").select("key", "hub", "id")
    sig = lambda c: held.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    body = lambda c: held.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    pairs = spokes.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    likely = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(near), "a long, b long")
    likely = scratch.write(likely, "likely").join(body("b"), "b").join(body("a"), "a")
    links = likely.select("a", "b", "text_a", "text_b").mapInArrow(_verify(near), "a long, b long")
    links = scratch.write(links, "near-links")
    found = scratch.write(components(links, scratch=scratch), "components")

    # buckets whose members aren't all of one component yet, and what hangs together by them
    labelled = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("of"))
    open_keys = labelled.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("key")
    family = components(spokes.join(open_keys, "key", "left_semi").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), scratch=scratch)
    family = scratch.write(family.select(F.col("node").alias("id"), F.col("component").alias("family")), "families")
    member = family.join(found.withColumnRenamed("node", "id"), "id", "left").select("family", "id", F.coalesce("component", "id").alias("of"))
    member = scratch.write(member, "family-members")
    sizes = member.groupBy("family", "of").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("family").agg(F.max_by("of", F.struct("n", -F.col("of"))).alias("most"), F.sum("n").alias("n"), F.max("n").alias("n_most")).filter("n > n_most")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    member = member.join(sizes.select("family", "most", blocks(F.col("n")).alias("ys"), blocks(F.col("n") - F.col("n_most")).alias("xs")), "family")
    block = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = member.filter("of <> most").select("family", block(F.col("xs")).alias("x"), every("ys").alias("y"), F.lit(True).alias("asks"), "id", "of")
    whole = member.select("family", every("xs").alias("x"), block(F.col("ys")).alias("y"), F.lit(False).alias("asks"), "id", "of")
    tasks, order = ["family", "x", "y"], ["family", "x", "y", "asks", "id"]
    dealt = rest.unionByName(whole)
    seen = dealt.join(held.select("id", "sig"), "id").select(*order, "of", "sig").repartition(*tasks).sortWithinPartitions(*order)
    needed = scratch.write(seen.mapInArrow(_needed(near), "family long, x long, y long, asks boolean, id long"), "needed")
    near_pairs = needed.join(member.select("family", "id", "of"), ["family", "id"]).join(held, "id").select(*order, "of", "sig", "text")
    more = scratch.write(near_pairs.repartition(*tasks).sortWithinPartitions(*order).mapInArrow(_compare(near), "a long, b long"), "near-links")
    found = scratch.write(components(links.union(more), scratch=scratch), "components")

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        described.select("id", "n_shingles", "digest")
        .join(of_class, "digest", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", near: Near = Near(), scratch: common.Scratch | None = None) -> DataFrame:
    """One document of each group, that with the smallest id; the columns that docs has."""
    stay = near_duplicates(docs, id_col, text, near, scratch).filter("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stay, F.col(id_col) == F.col("_stays"), "left_semi").union(docs.filter(F.col(id_col).isNull()))
