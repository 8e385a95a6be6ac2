"""The pipeline stage by stage, and as a whole."""

import math
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import pytest
from conftest import DOCS, sample_docs
from pyspark.sql import functions as F
from test_documents import WORD, check_packing, expected_signals, expected_whole_runs, near_components, token_ids

from vocalis.llm import common, minhash, mixing


def test_stages(spark, docs):
    now, columns, scratch = docs, docs.columns, common.Scratch(spark)
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.write(stage(spark, now, ""), "stage").cache()
        assert now.columns == columns, name
        counts.append(now.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in pieces)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.select("doc_id").collect()}


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_equals_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    a = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()}
    b = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()}
    assert a == b and a


def test_other_results_outlive_a_pipeline_run(spark, docs, tmp_path):
    """An operator's result that was not written yet reads tables that another scope's end leaves alone."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    waiting = minhash.near_duplicates(docs)
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert waiting.count() == docs.count()
    scratch = common.Scratch(spark)
    minhash.near_duplicates(docs, scratch=scratch).count()
    paths = list(scratch.paths)
    scratch.close()
    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_runs_at_one_time_leave_each_other_alone(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    a = corpus_pipeline.run(spark, str(tmp_path))
    b = corpus_pipeline.run(spark, str(tmp_path))
    with ThreadPoolExecutor(2) as pool:
        c, d = pool.map(lambda _: corpus_pipeline.run(spark, str(tmp_path)), range(2))
    assert a.count() == b.count() == c.count() == d.count() > 0


def test_stages_leave_unwritten_results_alone(spark, docs):
    first = corpus_pipeline.quality_rules(spark, docs, "")
    again = corpus_pipeline.quality_rules(spark, docs, "")
    corpus_pipeline.lines_deduplicated(spark, again, "").count()
    assert first.count() == again.count() > 0


ENDS = """
import sys
sys.path[:0] = sys.argv[3:]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://" + sys.argv[2]).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import corpus_pipeline
from vocalis.llm import queries
a = corpus_pipeline.run(spark, sys.argv[1])
assert a.count() > 0 and queries.op4_token_files(spark, sys.argv[1]).count() > 0
spark.stop()
"""


def test_nothing_is_left_in_the_shared_folder(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    os.makedirs(f"{tmp_path}/shared")
    root = os.path.dirname(corpus_pipeline.__file__)
    subprocess.run([sys.executable, "-c", ENDS, f"{tmp_path}/in", f"{tmp_path}/shared", root, *sys.path], check=True, timeout=600)
    assert [f for _, _, names in os.walk(f"{tmp_path}/shared") for f in names] == []
    assert not os.path.exists(f"{tmp_path}/shared/vocalis") or os.listdir(f"{tmp_path}/shared/vocalis") == []


def test_no_own_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda *_: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: None)
    with pytest.raises(ValueError):
        common.shared_dir(spark)


# --- the five stages in plain Python


def plain_quality(docs):
    facts = []
    for r in docs:
        n_words, _, n_symbols, n_dup, n_repeat = expected_signals(r["text"])
        n_lines = sum(bool(WORD.search(x)) for x in (r["text"] or "").split("\n"))
        facts.append((n_words < 50 or 100 * n_repeat > 50 * n_words, 100 * n_symbols > 50 * n_words, 100 * n_dup > 50 * n_lines))
    hosts = defaultdict(list)
    for r, f in zip(docs, facts):
        hosts[r["source"]].append(f)
    refused = set()
    for k in range(3):
        n, m = len(docs), sum(f[k] for f in facts) / max(1, len(docs))
        q = sum(sum(f[k] for f in fs) ** 2 / len(fs) for fs in hosts.values())
        between = q / n - m * m - m * (1 - m) * len(hosts) / n
        strength = max(1.0, min(1e6, m * (1 - m) / between - 1)) if between > 0 else 1e6
        refused |= {h for h, fs in hosts.items() if (sum(f[k] for f in fs) + m * strength) / (len(fs) + strength) > 0.5}
    return [r for r, f in zip(docs, facts) if not f[0] and r["source"] not in refused]


def plain_lines(docs):
    gone, out = expected_whole_runs([(r["doc_id"], r["text"]) for r in docs]), []
    for r in docs:
        lost = gone.get((r["doc_id"], r["text"]), set())
        text = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in lost)
        if not lost or WORD.search(text):
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def plain_near(docs):
    found = near_components([(r["doc_id"], r["text"]) for r in docs], minhash.Near())
    return [r for r in docs if found[r["doc_id"]][1] == r["doc_id"]]


def plain_mix(docs, hashes):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append(r)
    words = {s: sum(map(size, rs)) for s, rs in by.items()}
    goals, out = mixing.targets(words, (5, 2, 1), 3), []
    for s, rs in by.items():
        whole, rest = divmod(min(round(goals[s]), 3 * words[s]), words[s]) if words[s] else (0, 0)
        groups = defaultdict(list)  # rows of one hash and size go together
        for r in rs:
            groups[hashes[r["doc_id"]], size(r)].append(r)
        taken, first, up_to = set(), [], 0
        for key in sorted(groups):
            up_to += key[1] * len(groups[key])
            if up_to <= rest:
                first.append(key)
        taken, gap = set(first), rest - sum(k[1] * len(groups[k]) for k in first)
        classes = {}
        for key in groups:
            n = key[1] * len(groups[key])
            if key not in taken and 0 < n <= gap:
                c = int(math.log2(n))
                classes[c] = max(classes.get(c, (0,)), (n, *key))
        for n, *key in sorted(classes.values(), reverse=True):
            if n <= gap:
                gap -= n
                taken.add(tuple(key))
        for key, some in groups.items():
            out += [r for r in some if key[1] for _ in range(whole + (key in taken))]
    return out


def plain_pieces(docs, length=2048):
    return Counter(
        (r["doc_id"], s, len(x[s : s + length]), zlib.crc32(x[s : s + length].tobytes()), len(x)) for r in docs for x in [token_ids(r["text"], 1)] for s in range(0, len(x), length)
    )


@pytest.mark.parametrize("seed", [3, 12])
def test_run_against_plain_python(spark, tmp_path, seed):
    made = spark.createDataFrame(sample_docs(seed, 90), DOCS).repartition(3)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [r.asDict() for r in made.collect()]
    ids = spark.createDataFrame([(i,) for i in {r["doc_id"] for r in docs}], "doc_id long")
    hashes = {r.doc_id: r.h for r in ids.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()}
    counts, now = [len(docs)], docs
    for stage in (plain_quality, plain_lines, plain_near, lambda d: plain_mix(d, hashes)):
        now = stage(now)
        counts.append(len(now))
    assert counts[0] > counts[1] > counts[3] > 10 and counts[2] <= counts[1]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(got, plain_pieces(now), 2048)
