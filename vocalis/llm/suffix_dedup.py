"""Repeated byte strings across documents, by common-prefix intervals of an enhanced suffix array.

A suffix array over all bytes of a corpus is out of reach of a shuffle, so suffixes are sorted only
where a repeat can begin. Each window of LENGTH bytes has an anchor, the 16-byte string in it with the
least hash; equal windows have equal anchors. The windows that share an anchor's place are a run.

1. Parts of the corpus ask buckets of anchors which of their anchors other parts hold too, and which
   are hot: in so many different runs that they are to be dealt out by what stands beside them.
2. Runs whose anchor occurs more than once are offered, with their bytes and their first document, to
   the bucket of their anchor; equal runs of a part (compared as bytes) once. The run of a hot anchor is
   cut in two: windows that reach 17 bytes past the anchor go by the anchor and those bytes, the others,
   which reach 16 bytes back, by these and the anchor. So no bucket holds an anchor's whole company.
3. A bucket sorts its runs as bytes; equal ones are one string with all their documents. In slices of
   Sizes.suffixes, it sorts the suffixes at all windows of strings that share an anchor, finds the longest
   common prefixes of neighbours, and scans them with a stack: each interval of LENGTH bytes or more is
   a group of occurrences, all of them, with the longest string they share. Groups whose occurrences all
   follow the same byte are left out: the group one byte to the left says more. A string that several
   documents hold is a group too.
4. Of each group, the occurrences outside its first document are repeats. Groups go back to the parts
   that offered their runs, which know all places of a run; their union is removed.

Groups are those among runs: a repeat longer than a run (LENGTH + 34 bytes at most) is a chain of groups,
each overlapping the next by LENGTH - 1 bytes or more. `repeat_groups` returns them with all occurrences.

Memory: a part is Sizes.part bytes of documents (by hash, so about), a bucket holds what as many bytes
offer, and Sizes.suffixes are sorted at a time, or one key's in steps. Documents are compared by id; rows with one
id are one document (neither is earlier), kept apart by a hash of their text.

Defined results: null text is empty and nothing is removed; a null id takes no part and keeps its text;
repeated rows get the same result; texts shorter than LENGTH lose nothing; very long texts are looked at
whole, Sizes.slice bytes at a time; an empty table gives an empty table; other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common, exchange
from vocalis.llm.exchange import by_number, pack, unpack

LENGTH = 50
GRAM = 16
ROOM = 2 * LENGTH - GRAM


@dataclass(frozen=True)
class Sizes:
    """They bound memory and change no result: bytes of a part; bytes whose windows are looked at
    together; runs of an anchor from which on it is hot; suffixes that are sorted together."""

    part: int = exchange.PART_BYTES
    slice: int = 1 << 20
    hot: int = 512
    suffixes: int = 200_000


_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _C[2]
    x ^= x >> _U(29)
    x *= _C[3]
    x ^= x >> _U(32)
    return x


class Runs:
    """The runs of a buffer of documents: begin, n (windows), anchor (absolute), id (of the anchor),
    whole (fingerprint of the run, an order for finding equal ones) and doc (number of the document)."""

    def __init__(self, data: bytes, starts: np.ndarray, step: int, length: int = LENGTH):
        some = [_slice(data, a, min(len(data), a + step + length - 1), starts, length) for a in range(0, max(0, len(data) - length + 1), step)]
        some = some or [tuple(np.empty(0, np.uint64 if k > 3 else np.int64) for k in range(6))]
        self.begin, self.n, self.anchor, self.doc, self.id, self.whole = (np.concatenate(x) for x in zip(*some))


def _slice(data: bytes, a: int, b: int, starts: np.ndarray, length: int):
    """The runs of the windows in data[a:b]; a run that a slice's edge cuts is two runs."""
    n = b - a
    eight = np.ndarray((n - 7,), "<u8", memoryview(data)[a:b], strides=(1,))
    gram = eight[:-8] * _C[0]
    gram ^= gram >> _U(32)
    gram += eight[8:] * _C[1]
    gram *= _C[3]
    gram ^= gram >> _U(31)
    least = (gram & _U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    wide, have = length - GRAM + 1, 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    where = np.arange(a, a + len(at))
    fine = starts[np.searchsorted(starts, where, "right")] - where >= length
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~fine[:-1]
    last = np.ones(len(at), bool)
    last[:-1] = new[1:] | ~fine[1:]
    begin = np.flatnonzero(new & fine)
    n_windows = np.flatnonzero(last & fine) - begin + 1
    anchor = at[begin]
    tail = begin + n_windows + length - 1 - GRAM
    whole = (anchor - begin).astype(np.uint64) * _C[1] + n_windows.astype(np.uint64)
    for k in range(0, wide + length, GRAM):
        whole = _mix(whole + gram[np.minimum(begin + k, tail)])
    return begin + a, n_windows, anchor + a, np.searchsorted(starts, begin + a, "right") - 1, _mix(gram[anchor]), whole


def _grams(data: bytes, at: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return _mix(eight[at] * _C[0] ^ _mix(eight[at + 8] * _C[1]))


class Offers:
    """A part's runs that can hold a repeat, equal ones once. Offer k: begin, n, back (from its anchor),
    key, first (least document), several (whether other documents of the part have it), of (its run);
    run r stands at order[heads[r]:ends[r]]."""

    def __init__(self, part: exchange.Part, n_buckets: int, codes: dict[int, bytes] | None, sizes: Sizes):
        data, starts = b"".join(part.bodies), part.starts
        runs = self.runs = Runs(data, starts, sizes.slice)
        mine = part.ids[runs.doc]
        order = self.order = np.lexsort((mine, runs.whole, runs.id)) if len(mine) else np.empty(0, np.int64)
        i, w, d = runs.id[order], runs.whole[order], mine[order]
        head = np.ones(len(order), bool)
        head[1:] = (i[1:] != i[:-1]) | (w[1:] != w[:-1])
        self.flat = np.frombuffer(data + bytes(ROOM + 1), np.uint8)
        again = np.flatnonzero(~head)
        for a in range(0, len(again), 100_000):  # equal by fingerprint: compared as bytes
            k = again[a : a + 100_000]
            one, two = (self.strings(runs.begin[order[x]], runs.n[order[x]]) for x in (k, k - 1))
            head[k[(one != two).any(1)]] = True
        self.heads = np.flatnonzero(head)
        self.ends = np.append(self.heads[1:], len(order))
        anchors = i[self.heads]
        new = np.ones(len(anchors), bool)
        new[1:] = anchors[1:] != anchors[:-1]
        self.anchors, of = anchors[new], np.cumsum(new) - 1
        self.kinds = np.bincount(of, minlength=len(self.anchors))
        if codes is None:
            return
        code = np.zeros(len(self.anchors), np.uint8)
        for b, at in by_number((self.anchors % _U(n_buckets)).astype(np.int64)):
            if b in codes:
                (code[at],) = unpack(codes[b], "u1")
        several = d[self.heads] != d[self.ends - 1]
        run = np.flatnonzero(several | (code[of] > 0) | (self.kinds[of] > 1))
        rep = order[self.heads[run]]
        begin, n, anchor, key = runs.begin[rep], runs.n[rep], runs.anchor[rep], runs.id[rep]
        hot = code[of[run]] > 1
        left = begin + n
        cut = np.where(hot, np.clip(anchor - 17, begin, left), begin)  # from here on windows reach 17 bytes past the anchor
        right, back = left > cut, cut > begin
        beside = np.where(hot & right, _grams(data, np.where(hot & right, anchor + 17, 0)), _U(0)) if len(rep) else key
        before = np.where(back, _grams(data, np.where(back, anchor - 16, 0)), _U(0)) if len(rep) else key
        self.begin = np.concatenate([cut[right], begin[back]])
        self.n = np.concatenate([(left - cut)[right], (cut - begin)[back]])
        self.back = np.concatenate([(anchor - cut)[right], (anchor - begin)[back]])
        self.key = np.concatenate([np.where(hot, _mix(key ^ _mix(beside)), key)[right], _mix(_mix(key) + before)[back]])
        self.of = np.concatenate([run[right], run[back]])
        self.first = d[self.heads[self.of]]
        self.several = several[self.of]

    def strings(self, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The bytes of runs, padded with zeros: a row each."""
        text = np.lib.stride_tricks.sliding_window_view(self.flat, ROOM)[begin]
        text[np.arange(ROOM) >= (n + LENGTH - 1)[:, None]] = 0
        return text

    def places(self, offer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each offer's occurrences: which offer, which run of the part, and where the offer begins."""
        r = self.of[offer]
        size = self.ends[r] - self.heads[r]
        which = np.repeat(np.arange(len(offer)), size)
        at = self.order[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.heads[r], size)]
        shift = self.begin[offer] - self.runs.begin[self.order[self.heads[r]]]
        return which, at, self.runs.begin[at] + shift[which]


CODES, GROUPS = 0, 1


def _ask(n_buckets: int, sizes: Sizes):
    def run(part):
        o = Offers(part, n_buckets, None, sizes)
        yield from exchange.messages(part.number, (o.anchors % _U(n_buckets)).astype(np.int64), (o.anchors >> _U(32)).astype("<u4"), np.minimum(o.kinds, 255).astype("u1"))

    return run


def _tell(sizes: Sizes):
    """Whether other parts have an anchor: 1, or 2 where it is hot."""

    def run(bucket: int, parts: list[int], bodies: list[bytes]):
        some = [unpack(b, "<u4", "u1") for b in bodies]
        anchor, kinds = (np.concatenate(x) for x in zip(*some))
        _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
        code = np.where(times > 1, 1 + (np.bincount(inverse, kinds) > sizes.hot), 0).astype("u1")[inverse]
        ends = np.cumsum([len(x[0]) for x in some])
        for p, a, b in zip(parts, [0, *ends], ends):
            if code[a:b].any():
                yield p, CODES, pack(code[a:b])

    return run


def _offer(n_buckets: int, sizes: Sizes):
    def run(part):
        o = Offers(part, n_buckets, part.answers.get(CODES, {}), sizes)
        rows = []
        for b, at in by_number((o.key % _U(n_buckets)).astype(np.int64)):
            n = o.n[at]
            text = o.strings(o.begin[at], n)
            bare = text[np.arange(ROOM) < (n + LENGTH - 1)[:, None]]
            rows.append((b, part.number, pack((o.key[at] >> _U(32)).astype("<u4"), n.astype("u1"), o.back[at].astype("u1"), o.several[at].astype("u1"), o.first[at]) + bare.tobytes()))
        for a in range(0, len(rows), 500):
            yield exchange.batch(rows[a : a + 500], bucket=pa.int64(), part=pa.int64(), body=pa.binary())

    return run


def _group(every: bool, sizes: Sizes):
    """A bucket's groups, as (number of the offer in the part's message, from, to, group, first document)
    to each part. Unless every, only where an occurrence in the part can be a repeat."""

    def run(bucket: int, parts: list[int], bodies: list[bytes]):
        some = [unpack(b, "<u4", "u1", "u1", "u1", "<i8") for b in bodies]
        key, n, back, several, first = (np.concatenate(x) for x in zip(*some))
        n = n.astype(np.int64)
        sent = [len(x[0]) for x in some]
        of = np.repeat(np.arange(len(parts)), sent)
        number = np.arange(len(of)) - np.repeat(np.cumsum(sent) - sent, sent)
        text = np.zeros((len(n), ROOM), np.uint8)
        text[np.arange(ROOM) < (n + LENGTH - 1)[:, None]] = np.frombuffer(b"".join(b[8 + 15 * k :] for b, k in zip(bodies, sent)), np.uint8)
        order = np.lexsort((back, n, text.view(f"S{ROOM}").ravel(), key))
        sorted_text, k, m, back = text[order], key[order], n[order], back[order].astype(np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (back[1:] != back[:-1]) | (sorted_text[1:] != sorted_text[:-1]).any(1)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(order))
        least = np.minimum.reduceat(first[order], heads)
        many = (ends - heads > 1) | (np.maximum.reduceat(several[order], heads) > 0)
        string, size, k, back = sorted_text[heads], m[heads], k[heads], back[heads]
        found: list[tuple] = []  # strings, from, to, group, first document
        copies = np.flatnonzero(many)
        found.append((copies, np.zeros(len(copies), int), size[copies] + LENGTH - 1, np.arange(len(copies)), least[copies]))
        group = len(copies)
        for rows, at in _suffixes(k, size, back, sizes.suffixes):
            for shared, members, diverse in repeat_groups(string, rows, at, (size + LENGTH - 1)[rows], LENGTH):
                if diverse:
                    who = rows[members]
                    found.append((who, at[members], at[members] + shared, np.full(len(who), group), np.full(len(who), least[who].min())))
                    group += 1
        which, begin, end, number_of, whose = (np.concatenate(x) for x in zip(*found))
        # to every offer of each string
        times = (ends - heads)[which]
        row = np.repeat(np.arange(len(which)), times)
        offer = order[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(heads[which], times)]
        tell = np.flatnonzero(every | (first[offer] > whose[row]) | (several[offer] > 0))
        row, offer = row[tell], offer[tell]
        for p, at in by_number(of[offer]):
            r = row[at]
            yield parts[p], GROUPS, pack(number[offer[at]].astype("<u4"), begin[r].astype("u1"), end[r].astype("u1"), number_of[r].astype("<u4"), whose[r])

    return run


def _suffixes(key: np.ndarray, size: np.ndarray, back: np.ndarray, most: int):
    """The suffixes (strings and places) at all windows of strings that share a key, which are in order of
    the key, in slices of whole keys. A key with too many comes by the window's distance from the anchor,
    which equal windows have in common."""
    new = np.append(True, key[1:] != key[:-1])
    edge = np.append(np.flatnonzero(new), len(key))
    edge = np.stack([edge[:-1], edge[1:]])[:, np.diff(edge) > 1]
    count = np.append(0, np.cumsum(size))
    a = 0
    while a < edge.shape[1]:
        total = np.cumsum(count[edge[1, a:]] - count[edge[0, a:]])
        z = a + max(1, int(np.searchsorted(total, most, "right")))
        rows = np.concatenate([np.arange(x, y) for x, y in zip(edge[0, a:z], edge[1, a:z])])
        if total[0] > most:
            for away in range(int(back[rows].max()) + 1):
                at = back[rows] - away
                fine = (at >= 0) & (at < size[rows])
                if fine.sum() > 1:
                    yield rows[fine], at[fine]
        else:
            n = size[rows]
            row = np.repeat(rows, n)
            yield row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a = z


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(end)) - 1] if len(heads) else end[:0]


def intervals(prefixes: list[int], least: int):
    """Common-prefix intervals of at least `least`, children first, by one scan with a stack.
    prefixes[k] is what suffix k shares with suffix k + 1. Yields (shared, first, last, parent's shared)."""
    stack: list[tuple[int, int]] = []
    for k in range(len(prefixes) + 1):
        now = prefixes[k] if k < len(prefixes) and prefixes[k] >= least else 0
        begin = k
        while stack and stack[-1][0] > now:
            shared, begin = stack.pop()
            yield shared, begin, k
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


def repeat_groups(text: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray, least: int):
    """Maximal repeats among suffixes of the rows of a byte matrix. Suffix k is text[row[k], at[k]:size[k]].
    Yields (shared, suffixes): groups with all occurrences, children first. A group whose occurrences
    all follow one byte inside their rows is left out."""
    wide = text.shape[1]
    flat = np.append(text.ravel(), np.zeros(wide, np.uint8))
    keys = np.lib.stride_tricks.sliding_window_view(flat, least)[row * wide + at]
    order = np.argsort(keys.copy().view(f"S{least}").ravel(), kind="stable")
    sorted_keys = keys[order]
    same = (sorted_keys[1:] == sorted_keys[:-1]).all(1)
    if not same.any():
        return
    # within groups of equal keys, sort by what follows and measure it
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    inside = np.zeros(len(order), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        inside[a : b + 1] = True
    some = order[inside]
    group = np.cumsum(np.concatenate([[False], ~same]))[inside]
    rest = wide - least
    tail = np.lib.stride_tricks.sliding_window_view(flat, rest)[np.minimum(row[some] * wide + at[some] + least, len(flat) - rest)].copy()
    room = size[some] - at[some] - least
    tail[np.arange(rest) >= room[:, None]] = 0
    by = np.lexsort((tail.view(f"S{rest}").ravel(), group))
    some, group, tail, room = some[by], group[by], tail[by], room[by]
    differ = tail[1:] != tail[:-1]
    more = np.where(differ.any(1), differ.argmax(1), rest)
    more = np.minimum(more, np.minimum(room[1:], room[:-1]))
    shared = np.where(group[1:] == group[:-1], least + more, 0).tolist()
    before = np.where(at[some] > 0, flat[np.maximum(row[some] * wide + at[some] - 1, 0)].astype(np.int64), -1 - np.arange(len(some)))
    for depth, a, b in intervals(shared, least):
        left = before[a : b + 1]
        yield depth, some[a : b + 1], bool((left != left[0]).any())


def _located(part: exchange.Part, n_buckets: int, sizes: Sizes):
    """All occurrences in the part of the groups told: run, begin and end in the part, group, first document."""
    o = Offers(part, n_buckets, part.answers.get(CODES, {}), sizes)
    out = []
    sent = dict(by_number((o.key % _U(n_buckets)).astype(np.int64)))
    for b, raw in part.answers.get(GROUPS, {}).items():
        number, begin, end, group, first = unpack(raw, "<u4", "u1", "u1", "<u4", "<i8")
        which, run, at = o.places(sent[b][number])
        out.append((run, at + begin[which], at + end[which], group[which].astype(np.int64) + (b << 32), first[which]))
    return o, [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5


def _remove(n_buckets: int, sizes: Sizes):
    def run(part):
        o, (r, begin, end, _, first) = _located(part, n_buckets, sizes)
        doc, starts = o.runs.doc[r], part.starts
        later = first < part.ids[doc]
        # a gap of one between documents, so that spans of two don't meet
        begin, end = _union((begin + doc)[later], (end + doc)[later])
        doc = np.searchsorted(starts + np.arange(len(starts)), begin, "right") - 1
        spans = {d: (begin[at] - starts[d] - d, end[at] - starts[d] - d) for d, at in by_number(doc)}
        rows = []
        for d, body in enumerate(part.bodies):
            a, b = spans.get(d, ((), ()))
            h, at = hashlib.sha256(), 0
            for x, y in zip(a, b):
                h.update(body[at:x])
                at = y
            h.update(body[at:])
            rows.append((int(part.ids[d]), len(body), [{"begin": int(x), "end": int(y)} for x, y in zip(a, b)], h.hexdigest()))
        yield exchange.batch(rows, doc_id=pa.int64(), n_bytes=pa.int64(), spans=pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()})), kept_sha256=pa.string())

    return run


def _occurrences(n_buckets: int, sizes: Sizes):
    def run(part):
        o, (r, begin, end, group, first) = _located(part, n_buckets, sizes)
        doc, starts = o.runs.doc[r], part.starts
        for a in range(0, len(r), 50_000):
            d, s = doc[a : a + 50_000], slice(a, a + 50_000)
            columns = (group[s], part.ids[d], part.hashes[d], begin[s] - starts[d], end[s] - begin[s], first[s])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["group", "doc_id", "hash", "start", "length", "first_doc"])

    return run


def _exchanged(docs: DataFrame, id_col: str, text: str, sizes: Sizes, every: bool, scratch: common.Scratch):
    common.ship(docs.sparkSession)
    long_enough = docs.filter(F.octet_length(text) >= LENGTH)
    n = exchange.n_parts_of(long_enough, text, sizes.part)
    rows = exchange.rows_of(long_enough, id_col, text, n)
    codes = scratch.write(exchange.by_bucket(exchange.by_part(rows, _ask(n, sizes), exchange.MESSAGE), _tell(sizes)), "anchors")
    offered = exchange.by_part(exchange.with_answers(rows, codes), _offer(n, sizes), exchange.MESSAGE)
    groups = scratch.write(exchange.by_bucket(offered, _group(every, sizes)), "groups")
    return n, exchange.with_answers(rows, codes, groups)


def repeat_groups_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(), scratch: common.Scratch | None = None) -> DataFrame:
    """Every occurrence of every group: group, doc_id, hash (of the text), start, length, first_doc."""
    n, rows = _exchanged(docs, id_col, text, sizes, True, common.scope(docs, scratch))
    return exchange.by_part(rows, _occurrences(n, sizes), "group long, doc_id long, hash long, start long, length long, first_doc long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(), scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, begin and end in bytes) and kept_sha256 of every document."""
    n, rows = _exchanged(docs, id_col, text, sizes, False, common.scope(docs, scratch))
    spans = "array<struct<begin:bigint,end:bigint>>"
    found = exchange.by_part(rows, _remove(n, sizes), f"doc_id long, n_bytes long, spans {spans}, kept_sha256 string")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rest = docs.filter(F.col(id_col).isNull() | F.col(text).isNull() | (F.octet_length(text) < LENGTH))
    return found.unionByName(
        rest.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.array().cast(spans).alias("spans"), F.sha2(body, 256).alias("kept_sha256"))
    )
