"""Operators over documents against brute force, on texts with every odd case."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vocalis.llm import line_dedup, lm_score, minhash, mixing, packing, quality, queries, suffix_dedup, token_files
from vocalis.llm.common import new_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- quality rules


def expected_signals(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_quality_signals_and_hosts(docs):
    got = quality.judge(docs, "text", "source").select("row.doc_id", "row.text", "row.source", "signals.*", "base_failed", "kept", "rates.*").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected_signals(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    hosts = defaultdict(list)
    for r in got:
        hosts[r.source].append(r.base_failed)
    n = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / n
    between = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
    strength = max(1.0, min(1e6, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    for r in got:
        h = hosts[r.source]
        assert r.rate_base == pytest.approx((sum(h) + mean * strength) / (len(h) + strength))
        assert r.kept == (not r.base_failed and max(r.rate_base, r.rate_symbols, r.rate_lines) <= 0.5)


def test_quality_refuses_a_bad_host_and_keeps_a_good_one(spark):
    good = " ".join(f"word{i}" for i in range(80))
    made = [(i, good if i % 20 else "short", "good") for i in range(200)] + [(i, good if i % 10 == 0 else "short", "bad") for i in range(200, 400)]
    kept = {r.doc_id for r in quality.quality_filter(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert kept == {i for i in range(200) if i % 20}


def test_quality_of_nothing(no_docs):
    assert quality.quality_filter(no_docs).collect() == []


# --- tokens


def token_ids(text, end):
    t = Tokenizer.from_file(PATH)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark, docs):
    at = new_dir(spark, "t")
    files = token_files.write(docs, at, PATH, length=64)
    got = token_files.read(files, at).orderBy("start").collect()
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, t in rows(docs) for x in [token_ids(t, 0)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    first = files.orderBy("part").first()
    one = token_files.TokenFile(f"{at}/part-{first.part:05d}.arrow")
    n = -(-first.n_tokens // 64)
    ids, mask = one.sequence(n - 1)
    assert len(ids) == len(mask) == 64 and mask.sum() == first.n_tokens - 64 * (n - 1) and one.sequence(0)[1].all()
    assert np.concatenate([one.sequence(s)[0] for s in range(n)])[: first.n_tokens].tolist() == one.ids(0, first.n_tokens).tolist()


def test_token_files_of_nothing(spark, no_docs):
    at = new_dir(spark, "t")
    assert token_files.read(token_files.write(no_docs, at, PATH), at).collect() == []


def test_pieces_equal_whole_texts():
    from vocalis.llm.tokens import encoder

    texts = ["a   b", "it's 's  's\n\n  y", "...a'll", "12ab 3.4", " _a_ __b", "é'sà", "a \n\n b", "x<|endoftext|>y", "日本 語", "\x1c a\x85b", "", "naïve café"]
    e = encoder(PATH)
    assert e.encode(texts) == [e.whole(t) if t else b"" for t in texts]


def test_other_tokenizers_go_to_the_library_whole():
    from vocalis.llm.tokens import Encoder

    assert Encoder(PATH).by_pieces
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's  ONE test", "caf\u0065\u0301 12", "", None]
    assert not other.by_pieces
    assert other.encode(texts) == [other.whole(t) if t else b"" for t in texts]


def check_packing(got, want, length):
    pieces, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for seq in by_sequence.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    return by_sequence


def test_packing_holds_each_id_once(docs):
    got = packing.pack(docs, PATH, length=256).collect()
    want = Counter(
        (i, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x)) for i, t in rows(docs) for x in [token_ids(t, 1)] for s in range(0, len(x), 256)
    )
    check_packing(got, want, 256)


def padding(lengths, length=2048):
    """Share of padding, of pieces of these lengths as pack() places them: classes, patterns, slots."""
    demand = np.bincount(lengths, minlength=length + 1)[1:]
    of = packing.classes(demand)
    assert (of >= np.arange(1, length + 1)).all()
    need = np.bincount(of, demand, length + 1).astype(int)
    sizes = np.flatnonzero(need)
    used = packing.patterns(need[sizes], sizes, length)
    assert all(p @ sizes <= length for p, _ in used)
    assert (sum(p * n for p, n in used) >= need[sizes]).all()
    return 1 - sum(lengths) / (length * sum(n for _, n in used))


def test_packing_has_little_padding():
    r = np.random.default_rng(0)
    for n in (9, 17, 20):
        assert padding([n] * 12_800) <= 0.02
    assert padding(r.integers(1, 2049, 50_000).tolist()) <= 0.02
    assert padding((1 + r.gamma(1.2, 250, 50_000).astype(int) % 2048).tolist()) <= 0.02
    assert padding([3, 700, 700, 640, 2048, 1024, 1024]) < 0.17  # four sequences, as few as can be


def test_packing_is_as_tight_as_an_exhaustive_one():
    """Small cases against the best packing by search."""

    def best(left, bins):
        if not left:
            return len(bins)
        out, seen = len(left) + len(bins), set()
        for k, room in enumerate(bins):
            if room >= left[0] and room not in seen:
                seen.add(room)
                out = min(out, best(left[1:], [*bins[:k], room - left[0], *bins[k + 1 :]]))
        return min(out, best(left[1:], [*bins, 12 - left[0]]))

    r = random.Random(2)
    for _ in range(40):
        some = sorted((r.randint(1, 12) for _ in range(7)), reverse=True)
        need = np.bincount(some, minlength=13)
        sizes = np.flatnonzero(need)
        used = packing.patterns(need[sizes], sizes, 12)
        assert best(some, []) <= sum(n for _, n in used) <= best(some, []) + 1


def test_packing_fills_sequences(spark):
    """In tokens, through the whole operator: documents of few lengths."""
    d = spark.createDataFrame([(i, " a" * (8 + 8 * (i % 3))) for i in range(6000)], "doc_id long, text string")
    got = packing.pack(d, PATH).collect()
    assert sum(r.length for r in got) >= 0.98 * 2048 * len({r.sequence_id for r in got})


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []


# --- near duplicates


def near_components(pairs_of, near):
    """Of each id, by its text with the least digest."""
    sets, digest = {}, lambda t: hashlib.blake2b(minhash.shingles(t, near.shingle).tobytes(), digest_size=16).digest()
    for i, t in sorted(pairs_of, key=lambda x: digest(x[1]), reverse=True):
        w = WORD.findall((t or "").translate(minhash.LOWER))
        k = near.shingle
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and near.den * both >= near.num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("near", [minhash.Near(), minhash.Near(3, 85, 100)])
def test_near_duplicates(docs, near):
    pairs = rows(docs)
    want = near_components(pairs, near)
    size = lambda t: len(minhash.shingles(t, near.shingle))
    found = minhash.near_duplicates(docs, near=near).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter((i, size(t), want[i][1]) for i, t in pairs)
    assert len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_in_large_families(spark, monkeypatch):
    """Many documents about one text, some nearer to each other than to the rest; small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r, made = random.Random(9), []
    base = [f"w{i}" for i in range(120)]
    for i in range(150):
        words = base.copy()
        for k in r.sample(range(120), (0, 3, 6, 9)[i % 4]):
            words[k] = f"n{r.randint(0, 40)}"
        made.append((i, " ".join(words)))
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    want = near_components(made, minhash.Near())
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(d).collect()} == want
    assert 1 < len({c for _, c in want.values()}) < 150


def test_near_duplicates_keep_chains_through_other_documents(spark):
    base = [f"w{i}" for i in range(200)]
    chain = []
    for k in range(40):  # each is near the next one only
        chain.append((k, " ".join(base)))
        base = base.copy()
        base[(k * 5) % 200] = f"n{k}"
    made = spark.createDataFrame(chain, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(made).collect()}
    assert got == {i: c for i, (_, c) in near_components(chain, minhash.Near()).items()}


def test_near_dedup_keeps_one_of_each(docs, no_docs):
    once = docs.dropDuplicates(["doc_id"]).cache()
    left = minhash.near_dedup(once)
    assert left.columns == docs.columns
    want = near_components(rows(once), minhash.Near())
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert minhash.near_dedup(no_docs).collect() == []


def test_least_matches_is_a_posterior_bound():
    assert minhash.least_matches(144, 0.8, 0.0) == 0
    assert 0.5 * 144 < minhash.least_matches(144, 0.8) < 0.8 * 144
    for t in (0.8, 0.85):
        near = minhash.Near(num=int(t * 100))
        assert (1 - t**near.band_rows) ** (minhash.K // near.band_rows) <= minhash.BAND_MISS


# --- lines


def expected_lines(pairs, least=20):
    strip = " \t\n\x0b\x0c\r"
    docs = sorted({(i, t) for i, t in pairs if t is not None}, key=lambda x: x[0])
    seen, gone = {}, defaultdict(set)
    for key in docs:
        lines = [(n, x.strip(strip)) for n, x in enumerate(key[1].split("\n")) if x.strip(strip)]
        for p in range(len(lines)):
            total = 0
            for depth in range(1, len(lines) - p + 1):
                total += len(WORD.findall(lines[p + depth - 1][1]))
                if total >= least:
                    run = tuple(x for _, x in lines[p : p + depth])
                    if run in seen:
                        gone[key] |= {n for n, _ in lines[p : p + depth]}
                    seen.setdefault(run, key)
                    break
    return gone


def test_line_dedup(docs):
    once = docs.dropDuplicates(["doc_id"]).cache()
    gone = expected_lines(rows(once))
    got = line_dedup.line_dedup(once, whole_runs=False).select("row.*", "n_lines", "n_removed", "n_spans").collect()
    before = dict(rows(once))
    assert len(got) == len(before) and any(gone.values())
    for r in got:
        was = before[r.doc_id]
        out = gone.get((r.doc_id, was), set())
        assert r.n_removed == len(out)
        assert r.text == (None if was is None else "\n".join(x for n, x in enumerate(was.split("\n")) if n not in out))
        assert r.n_lines == (0 if was is None else was.count("\n") + 1)


def test_line_dedup_of_runs_of_short_lines(spark):
    run = "\n".join(f"line {k} of seven words in all" for k in range(8))
    made = [(1, f"first\n{run}\nend one"), (2, f"other\n\n{run}\n\nend two"), (3, run.split("\n")[0]), (4, run + "\n" + run)]
    got = {r.doc_id: (r.text, r.n_removed, r.n_spans) for r in line_dedup.line_dedup(spark.createDataFrame(made, "doc_id long, text string")).select("row.*", "n_removed", "n_spans").collect()}
    assert got[1] == (made[0][1], 0, 0)
    assert got[2] == ("other\n\n\nend two", 8, 1)
    assert got[3] == (made[2][1], 0, 0)
    assert got[4] == ("", 16, 1)


def removed_spans(text, out):
    """Maximal runs of removed lines; lines without words don't end one."""
    wordy = [n in out for n, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    return sum(now and not before for before, now in zip([False, *wordy], wordy))


def expected_whole_runs(pairs, least=20):
    """Lines in any run of least words that an earlier place holds too, by comparing all places."""
    strip, seq = " \t\n\x0b\x0c\r", []
    for i, t in sorted({(i, t) for i, t in pairs if t is not None}, key=lambda x: x[0]):
        seq += [(i, t, n, x.strip(strip)) for n, x in enumerate(t.split("\n")) if x.strip(strip)] + [None]
    at, gone = defaultdict(list), defaultdict(set)
    for p, x in enumerate(seq):
        if x is None:
            continue
        for q in at[x[3]]:
            k = 0
            while seq[p + k] and seq[q + k] and seq[p + k][3] == seq[q + k][3]:
                k += 1
            if sum(len(WORD.findall(y[3])) for y in seq[p : p + k]) >= least:
                gone[x[:2]] |= {y[2] for y in seq[p : p + k]}
        at[x[3]].append(p)
    return gone


def test_line_dedup_of_whole_runs(docs, spark):
    line = lambda k, w: " ".join([w] * k)
    run = "\n".join([line(30, "a"), line(9, "b"), line(9, "c")])
    made = [(1, run), (2, run), (3, f"x\n{run}\n{line(25, 'y')}"), (4, f"{run}\n{line(25, 'y')}"), (5, f"{line(9, 'b')}\n{line(9, 'c')}"), (6, "\n".join(f"s{k % 7}" for k in range(60)))]
    again = [(7, run), (7, run), (7, None), (None, None)]  # repeated rows are one document
    for d in (spark.createDataFrame(made + again, "doc_id long, text string"), docs.dropDuplicates(["doc_id"]), docs.filter("doc_id > 1")):
        pairs = rows(d)
        gone, want = expected_whole_runs(pairs), Counter()
        for i, was in pairs:
            out = gone.get((i, was), set())
            want[i, None if was is None else "\n".join(x for n, x in enumerate(was.split("\n")) if n not in out), len(out), removed_spans(was, out)] += 1
        got = line_dedup.line_dedup(d).select("row.doc_id", "row.text", "n_removed", "n_spans").collect()
        assert Counter(map(tuple, got)) == want and any(gone.values())


def test_line_spans_over_lines_without_words(spark):
    run = "\n".join(f"row {k} " + "z " * 25 for k in range(4))
    made = [(1, run), (2, "own\n" + run.replace("\n", "\n \n") + "\nend"), (3, "\n\n" + run.split("\n")[0] + "\nmid\n" + run.split("\n")[3])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in line_dedup.line_dedup(spark.createDataFrame(made, "doc_id long, text string")).select("row.doc_id", "n_removed", "n_spans").collect()}
    assert got == {1: (0, 0), 2: (4, 1), 3: (2, 2)}


def test_line_dedup_of_nothing(no_docs, docs):
    assert line_dedup.deduplicated(no_docs).collect() == []
    assert line_dedup.deduplicated(docs).columns == docs.columns


# --- mixing


def test_targets_share_again_what_is_above_the_cap():
    got = mixing.targets({"b": 100, "a": 10, None: 50}, (5, 2, 1), 3)
    assert got == {"a": 30.0, "b": pytest.approx(130 * 2 / 3), None: pytest.approx(130 / 3)}
    assert list(got) == ["a", "b", None]


def test_route_fills_quotas_at_least_cost():
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15}, 3)
    assert given == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    given = mixing.route({("a",): 10, ("b",): 10}, {"a": 25, "b": 5}, 3)
    assert given == {("a",): 25, ("b",): 5}


def test_mix_meets_targets_and_reruns_agree(spark):
    made = [(i, " ".join(["w"] * (1 + i * 7 % 60)), None if i % 10 == 0 else "abc"[i % 3]) for i in range(3000)]
    d = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(d).select("row.*", "size", "pattern_size", "target", "taken").collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in mixing.mix(d.repartition(2)).select("row.*", "taken").collect()}
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r.size == len(WORD.findall(r.text)) and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    assert {k: v[2] for k, v in by.items()} == pytest.approx(mixing.targets({k: v[0] for k, v in by.items()}, (5, 2, 1), 3))
    for size, taken, target in by.values():
        assert abs(taken - target) <= max(2, 1e-3 * target)


def test_mix_of_overlapping_sources(spark):
    made = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(400)]
    d = spark.createDataFrame(made, "doc_id long, text string, s array<string>")
    got = mixing.mix(d, sources=F.col("s"), how=mixing.Mix(weights=(3, 1))).select("row.*", "taken").collect()
    assert sum(r.taken for r in got if not r.s) == 0
    # a word in both sources counts for each
    assert sum(r.taken for r in got) == 4000


def cheapest(supply, quota, passes):
    """The most words that patterns can give, and at what least cost, by trying every amount (small cases)."""
    patterns = list(supply)

    def spread(amounts):
        """Whether the sources can take these amounts: Hall's condition over sets of sources."""
        names = list(quota)
        return all(
            sum(n for p, n in zip(patterns, amounts) if set(p) <= {x for k, x in enumerate(names) if m >> k & 1}) <= sum(quota[x] for k, x in enumerate(names) if m >> k & 1)
            for m in range(1 << len(names))
        )

    def cost(p, n):
        out, k = 0, 0
        while n > 0:
            out += min(n, supply[p]) * (0, 1, 3, 7)[k]
            n, k = n - supply[p], k + 1
        return out

    some = [a for a in itertools.product(*(range(passes * supply[p] + 1) for p in patterns)) if spread(a)]
    most = max(map(sum, some))
    return most, min(sum(map(cost, patterns, a)) for a in some if sum(a) == most), cost


def test_route_is_a_flow_of_least_cost():
    r = random.Random(8)
    for _ in range(60):
        names = ["a", "b", "c"][: r.randint(1, 3)]
        every = [p for k in range(1, len(names) + 1) for p in itertools.combinations(names, k)]
        supply = {p: r.randint(0, 3) for p in r.sample(every, r.randint(1, min(4, len(every))))}
        quota = {x: r.randint(0, 9) for x in names}
        most, least, cost = cheapest(supply, quota, 2)
        given = mixing.route(supply, quota, 2)
        assert sum(given.values()) == most and all(0 <= given[p] <= 2 * supply[p] for p in supply)
        assert sum(cost(p, n) for p, n in given.items()) == least


def test_route_of_many_sources_is_quick():
    r = random.Random(1)
    names = [f"s{i}" for i in range(10_000)]
    supply = {(x,): r.randint(1, 1000) for x in names} | {tuple(sorted(r.sample(names, r.randint(2, 4)))): r.randint(1, 1000) for _ in range(10_000)}
    sizes = Counter()
    for p, n in supply.items():
        for x in p:
            sizes[x] += n
    began = time.process_time()
    quota = {x: round(v) for x, v in mixing.targets(sizes, (5, 2, 1), 3).items()}
    given = mixing.route(supply, quota, 3)
    assert time.process_time() - began < 10
    assert sum(given.values()) <= sum(quota.values())


def test_mix_tells_all_patterns_apart(spark):
    r = random.Random(5)
    made = [(i, "w " * r.randint(1, 30), sorted(r.sample("abcdefghij", r.randint(1, 6)))) for i in range(1_500)]
    d = spark.createDataFrame(made, "doc_id long, text string, of array<string>")
    got = mixing.mix(d, sources=F.col("of")).collect()
    by = {x.row.doc_id: x for x in got}
    assert len(got) == 1_500 and all(list(by[i].pattern) == of and by[i].taken in {k * by[i].size for k in range(4)} for i, _, of in made)
    supply, taken, by_source = Counter(), Counter(), Counter()
    for x in got:
        supply[tuple(x.pattern)] += x.size
        taken[tuple(x.pattern)] += x.taken
        by_source.update(dict.fromkeys(x.pattern, x.size))
    assert len(supply) > 500
    share = mixing.targets(dict(by_source), mixing.Mix().weights, 3)
    given = mixing.route(dict(supply), {k: round(v) for k, v in share.items()}, 3)
    assert all(0 <= given[p] - taken[p] < 30 for p in supply)  # less than one document short of the flow


def test_mix_of_odd_rows(docs, no_docs):
    assert mixing.mixed(no_docs).collect() == []
    out = mixing.mix(docs).select("row.doc_id", "row.text", "size", "taken").collect()
    assert len(out) == docs.count()
    assert all(r.taken == 0 for r in out if not WORD.search(r.text or ""))
    assert mixing.mixed(docs).columns == docs.columns


# --- language models


def naive_scores(texts, listed, order=2, mix=0.7):
    """Mean losses of each text by both models, counted without that text."""

    def tokens(t):
        ws = WORD.findall(t or "")
        return [*ws, "</s>"] if ws else []

    def grams(t, k):
        ws = tokens(t)
        return [tuple(ws[j] if j >= 0 else "<s>" for j in range(i - k, i + 1)) for i in range(len(ws))]

    vocabulary = len({w for t in texts for w in tokens(t)})
    out = []
    for i, t in enumerate(texts):
        ways = []
        for others in ([x for j, x in enumerate(texts) if j != i and listed[j]], [x for j, x in enumerate(texts) if j != i]):
            count = [Counter(g for x in others for g in grams(x, k)) for k in range(order)]
            total, loss = sum(count[0].values()), []
            for at in range(len(tokens(t))):
                p = 1 / max(1, vocabulary)
                for k in range(order):
                    g = grams(t, k)[at]
                    c = total if k == 0 else count[k - 1][grams(t, k - 1)[at - 1]] if at else 0
                    p = mix * count[k][g] / c + (1 - mix) * p if c else p
                loss.append(-np.log(p))
            ways.append(sum(loss) / max(1, len(loss)))
        out.append((len(tokens(t)), *ways, ways[1] - ways[0]))
    return out


@pytest.mark.parametrize("order,part_bytes", [(2, 8 << 20), (2, 60), (3, 100), (1, 100)])
def test_lm_score_against_plain_counts(spark, order, part_bytes):
    texts = ["the cat sat on the mat", "the cat sat", None, "", " tac eht\n\ttas\u00e9 ", "the mat sat on", "the cat sat", "a " * 40, "a"]
    listed = [True, True, True, False, False, False, False, True, False]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i, x in enumerate(listed) if x] + [(None,)], "doc_id long")
    got = {r.doc_id: tuple(r)[1:] for r in lm_score.score(d, ids, order=order, part_bytes=part_bytes).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(naive_scores(texts, listed, order)):
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_lm_score_of_odd_rows(docs, no_docs):
    ids = docs.filter("source = 'hot'").select("doc_id")
    assert lm_score.score(no_docs, ids).collect() == []
    got = lm_score.score(docs, ids).collect()
    assert len(got) == docs.count() and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    none = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.doc_id for r in lm_score.score(none, ids).collect()] == [None] * 3


def test_lm_score_held_out(spark):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdefghi"), 4)) for _ in range(60)]
    make = lambda some: " ".join(r.choice(some, 40))
    made = [(i, make(words[:40] if i % 2 else words[20:])) for i in range(200)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    score = {x.doc_id: x.score for x in lm_score.score(d, d.filter("doc_id % 2 = 1 and doc_id < 100").select("doc_id")).collect()}
    assert min(score[i] for i in range(101, 200, 2)) > max(score[i] for i in range(100, 200, 2))


def test_lm_score_sees_texts_that_occur_twice(spark):
    r = np.random.default_rng(2)
    words = ["".join(r.choice(list("abcdefghi"), 4)) for _ in range(300)]
    texts = [" ".join(r.choice(words, 60)) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(texts + texts[:10])), "doc_id long, text string")
    loss = {x.doc_id: x.loss_background for x in lm_score.score(d, d.limit(0).select("doc_id")).collect()}
    assert max(loss[i] for i in range(10)) < min(loss[i] for i in range(10, 120))


# --- repeated bytes


def expected_bytes(pairs):
    seen, out = {}, {}
    for i in sorted({i for i, _ in pairs}):
        own = set()
        for t in {t for j, t in pairs if j == i}:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for s in range(len(b) - 49):
                if b[s : s + 50] in seen:
                    gone[s : s + 50] = True
                own.add(b[s : s + 50])
            edges = np.diff(np.concatenate([[0], gone.astype(int)]))
            out[i, t] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
        for w in own:
            seen.setdefault(w, i)
    return out


def digest(found):
    return [(r.doc_id, r.n_bytes, sum(x.end - x.begin for x in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()]


SIZES = [suffix_dedup.Sizes(), suffix_dedup.Sizes(1500, 700, 512, 40), suffix_dedup.Sizes(1500, 700, 1), suffix_dedup.Sizes(9000, 1 << 20, 1, 10)]


@pytest.mark.parametrize("sizes", SIZES)
def test_repeated_bytes(docs, sizes):
    pairs = rows(docs)
    want = Counter((i, *expected_bytes(pairs)[i, t]) for i, t in set(pairs) for _ in range(pairs.count((i, t))))
    got = digest(suffix_dedup.without_repeats(docs, sizes=sizes))
    assert Counter(got) == want
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("sizes", SIZES[:3])
def test_repeat_groups_have_all_occurrences(spark, sizes):
    """Each group's occurrences are one string, and every 50-byte string of two documents is in a group with all its places."""
    r = random.Random(4)
    bits = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(30, 90))) for _ in range(12)]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 6))) for _ in range(40)]
    found = suffix_dedup.repeat_groups_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sizes=sizes).collect()
    groups = defaultdict(set)
    for x in found:
        groups[x.group].add((texts[x.doc_id][x.start : x.start + x.length], x.doc_id, x.start))
    where = defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            where[t[p : p + 50]].add((i, p))
    covered = defaultdict(set)
    for members in groups.values():
        (text,) = {t for t, _, _ in members}
        assert len(text) >= 50
        for k in range(len(text) - 49):
            covered[text[k : k + 50]] |= {(d, s + k) for _, d, s in members}
    want = {w: at for w, at in where.items() if len({d for d, _ in at}) > 1}
    assert want and all(covered[w] == at for w, at in want.items())


def test_a_hot_anchor_in_many_contexts(spark):
    """One passage in thousands of documents whose neighbourhoods all differ, in small parts and slices."""
    r, passage = random.Random(6), "the passage that every document of this corpus holds, word for word, to the end"
    some = lambda: "".join(r.choice("klmnopqrst ") for _ in range(r.randint(20, 60)))
    texts = [some() + passage + some() for _ in range(4000)]
    pairs = list(enumerate(texts))
    d = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    got = digest(suffix_dedup.without_repeats(d, sizes=suffix_dedup.Sizes(60_000, 1 << 20, 64, 5_000)))
    want = expected_bytes(pairs)
    assert Counter(got) == Counter((i, *want[i, t]) for i, t in pairs)


def test_repeated_bytes_of_nothing(no_docs):
    assert suffix_dedup.without_repeats(no_docs).collect() == []


def test_repeat_groups_are_all_maximal_repeats():
    r = np.random.default_rng(5)
    for _ in range(20):
        text = r.integers(97, 99, (3, 40)).astype(np.uint8)
        least = 4
        row, at = (x.ravel() for x in np.mgrid[0:3, 0 : 40 - least + 1])
        got = {}
        for shared, members, diverse in suffix_dedup.repeat_groups(text, row, at, np.full(len(row), 40), least):
            if diverse:
                key = text[row[members[0]], at[members[0]] : at[members[0]] + shared].tobytes()
                got[key] = {(int(row[m]), int(at[m])) for m in members}
        want = defaultdict(set)
        for i in range(3):
            for j in range(40):
                for n in range(least, 40 - j + 1):
                    want[text[i, j : j + n].tobytes()].add((i, j))
        maximal = {}
        for key, where in want.items():
            right = {text[i, j + len(key)] if j + len(key) < 40 else -1 - i for i, j in where}
            left = {text[i, j - 1] if j else -1 - i for i, j in where}
            if len(where) > 1 and len(right) > 1 and len(left) > 1:
                maximal[key] = where
        assert got == maximal


def test_encoder_equals_the_library_and_keeps_no_long_piece():
    from vocalis.llm import tokens

    encoder, r = tokens.Encoder(PATH), random.Random(8)
    alphabet = "ab Cé,.'s\n\n 12-  x—“”!?t_\t"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3_000)]
    texts += ["\n", "\n\n", "a\n", " a", "a ", "a\n\nb", "a\n\n\nb", "\na", "it's\n'tis 'll x", "a 's b", "a '", "x\x01y", None]
    texts += ["".join(r.choice("qwertz") for _ in range(20_000)) for _ in range(5)]
    got = [x for a in range(0, len(texts), 100) for x in encoder.encode(texts[a : a + 100])]
    assert got == [encoder.whole(t) if t else b"" for t in texts]
    assert max(map(len, encoder.memo)) <= tokens.LONGEST
