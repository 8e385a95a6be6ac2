"""Filter audit, sharding and the Merkle manifest against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vocalis.llm import filter_audit, merkle, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter interactions


def expected_audit(docs, labels):
    first = {}
    for d in docs:
        if d.doc_id is not None:
            x = d.text or ""
            first[x] = min(first.get(x, d.doc_id), d.doc_id)
    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    by_part = defaultdict(list)
    for d in docs:
        x, w = d.text or "", WORD.findall(d.text or "")
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x),
            "D": bool(re.search(r"[#$%&*|]", x)),
            "E": d.doc_id is not None and first[x] < d.doc_id,
        }
        by_part[d.lang or ""].append(({f for f in fails if fails[f]}, d.doc_id in good, d.doc_id in toxic))
    out = {}
    for part, rows in by_part.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                prior = set(order[: step - 1])
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[0] and bool(r[0] & prior) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = total[v[-1]] if isinstance(v[-1], str) else v[-1]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_of_every_order_and_step(spark, docs):
    long = " ".join(f"w{i} x{i % 7}" for i in range(150))
    more = [(None, long, "en"), (None, long, None), (70, long, ""), (71, long, "en"), (71, long, "en"), (71, long + " A", "en"), (72, "AB " * 300, "it"), (72, "AB " * 300, "de")]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True).repartition(5).cache()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 80, 2)] + [(3, None, 1), (5, 1, None), (5, 0, None), (None, 1, 1), (71, 1, 1)]
    got = filter_audit.audit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    assert found == expected_audit(rows.collect(), labels)


def test_audit_of_nothing(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs, labels).collect() == []


def test_words_are_aggregated_without_a_shuffle_of_words(spark, docs):
    plan = filter_audit.word_totals(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of whole texts, then of a row by document


# --- sharding


def shards_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "id long, key string").repartition(4)
    return sharding.shard(df, ["key"], ["id", "key"], sharding.Shards(**how)).collect()


def checked(found, n):
    sizes = Counter(r.shard for r in found)
    assert all(0 <= s < n for s in sizes)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(n)), default=0) <= 1
    for s in range(n):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes.get(s, 0)))
    groups = defaultdict(Counter)
    for r in found:
        if r.key is not None:
            groups[r.key][r.shard] += 1
    return groups


def test_groups_that_fit_stay_whole_and_large_ones_fill_few_shards(spark):
    r = random.Random(5)
    rows = [(i, "hot") for i in range(700)] + [(1000 + i, f"g{r.randrange(250)}") for i in range(900)] + [(5000 + i, None if i % 2 else f"alone{i}") for i in range(501)]
    r.shuffle(rows)
    found = shards_of(spark, rows)
    assert Counter((x.id, x.key) for x in found) == Counter(rows)
    groups = checked(found, 8)
    assert len(groups["hot"]) <= 4  # a third of all rows: three quotas hold them
    assert sum(len(v) > 1 for k, v in groups.items() if k != "hot") <= 5


def test_every_row_linked_and_no_room_to_spare(spark):
    found = shards_of(spark, [(i, f"p{i // 2}") for i in range(640)], rounds=30)
    groups = checked(found, 8)
    assert sum(len(v) > 1 for v in groups.values()) <= 16  # 280 of 320 pairs are cut by chance


def test_shards_of_odd_tables(spark):
    assert shards_of(spark, []) == []
    checked(shards_of(spark, [(1, None)]), 8)
    checked(shards_of(spark, [(1, "a")] * 5), 8)
    same = checked(shards_of(spark, [(7, "same")] * 100 + [(None, None)] * 3, n=3), 3)
    assert sum(same["same"].values()) == 100


def test_several_keys_and_the_cut(spark):
    r = random.Random(9)
    rows = [(i, f"h{i % 40}", f"t{r.randrange(30)}" if i % 3 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, host string, topic string")
    found = sharding.shard(df, ["host", "topic"], ["id"], sharding.Shards(4))
    cut = {x.key: (x.links, x.cut_links) for x in sharding.cut(found, ["host", "topic"]).collect()}
    by = defaultdict(lambda: defaultdict(Counter))
    for x in found.collect():
        for k in ("host", "topic"):
            if x[k] is not None:
                by[k][x[k]][x.shard] += 1
    for k, (links, gone) in cut.items():
        n = [sum(c.values()) for c in by[k].values()]
        assert links == sum(m * (m - 1) / 2 for m in n)
        assert gone == links - sum(m * (m - 1) / 2 for c in by[k].values() for m in c.values())
    assert sum(g for _, g in cut.values()) < 0.55 * sum(n for n, _ in cut.values())  # by chance three quarters


def brute_circulation(asked, room):
    best = 0
    moves = list(asked)
    for chosen in itertools.product(*(range(asked[m] + 1) for m in moves)):
        net = Counter()
        for (f, t, _), n in zip(moves, chosen):
            net[t] += n
            net[f] -= n
        if all(net[s] <= room[s] for s in range(len(room))):
            best = max(best, sum(n * m[2] for m, n in zip(moves, chosen)))
    return best


def test_circulation_is_the_best_one():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(2, 3)
        asked = {}
        for _ in range(r.randint(1, 5)):
            f, t = r.randint(-1, n - 1), r.randrange(n)
            if f != t:
                asked[f, t, 2 ** r.randint(0, 3)] = r.randint(1, 4)
        room = [r.randint(0, 3) for _ in range(n)]
        got = sharding.circulation(asked, room)
        net = Counter()
        for (f, t, _), k in got.items():
            net[t] += k
            net[f] -= k
        assert all(0 <= got[m] <= asked[m] for m in asked) and all(net[s] <= room[s] for s in range(n))
        assert sum(k * m[2] for m, k in got.items()) == brute_circulation(asked, room)


def test_op12_keeps_equal_texts_together(spark):
    found = queries.op12_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in found} == set(docs)
    for r in found:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    by_text = defaultdict(set)
    for r in found:
        by_text[docs[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in by_text.values())


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encode(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way_of(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = nodes[i - i % 2 : i - i % 2 + 2]
        out.append(("".join(run[: i % 2]), "".join(run[i % 2 + 1 :])))
        i //= 2
    return out


def expected_manifest(rows):
    by_part = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h(*map(encode, (doc_id, source, lang, n_chars, text)))
        own = leaf
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            own = h(*map(encode, (doc_id, source, lang, n_chars + 1, text)))
        by_part[lang].append((doc_id is not None, doc_id or 0, leaf, own))
    parts = sorted(by_part, key=lambda x: (x is not None, (x or "").encode()))
    trees = {p: levels([x[2] for x in sorted(by_part[p])]) for p in parts}
    upper = levels([trees[p][-1][0] for p in parts])
    out = []
    for j, p in enumerate(parts):
        for i, (there, doc_id, leaf, own) in enumerate(sorted(by_part[p])):
            way = way_of(trees[p], i) + way_of(upper, j)
            for before, after in way:
                own = h(before, own, after)
            out.append((doc_id if there else None, leaf, trees[p][-1][0], upper[-1][0], h("".join(b + a for b, a in way)), own, own == upper[-1][0]))
    return out


def test_manifest_against_plain_python(spark, docs, tmp_path):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars if r.doc_id != 3 else None, r.text) for r in docs.collect()]
    rows += [(1000 + i, "s", "en", i, f"é{i}") for i in range(2100)] + [(None, None, "", None, None), (None, "x", "en", 9, ""), (2**40, "s", "zz", 2**63 - 1, "one")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    at = str(tmp_path)
    df.write.parquet(f"{at}/documents.parquet")
    got = queries.op13_merkle(spark, at)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(expected_manifest(rows))


def test_manifest_of_nothing_and_of_one(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for rows in ([], [(5, None, None, 3, "x")]):
        at = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        assert list(map(tuple, queries.op13_merkle(spark, at).collect())) == expected_manifest(rows)


def test_partials_take_events_in_any_order_and_merge():
    r = random.Random(4)
    for n in (1, 2, 3, 7, 8, 9, 100, 1023, 1024):
        digests = [h(str(i)) for i in range(n)]
        tree, parts = levels(digests), [None] * 3
        events = [(n, i, d, i) for i, d in enumerate(digests)]
        r.shuffle(events)
        for e in events:
            k = r.randrange(3)
            parts[k] = parts[k].add(e) if parts[k] else merkle._new(e)
        whole = None
        for p in filter(None, parts):
            whole = whole.merge(p) if whole else p
        assert not whole.waiting and whole.nodes[max(whole.nodes)] == tree[-1][0]
        assert whole.nodes == {(level, i): d for level, nodes in enumerate(tree) for i, d in enumerate(nodes)}
        for i in range(n):
            assert whole.way(i) == way_of(tree, i) and merkle.folded(digests[i], whole.way(i)) == tree[-1][0]
