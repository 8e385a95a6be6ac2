"""Sequences in blocks against plain Python, with blocks small enough for every document to have several."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vocalis.operators import reading, sequences


def units_of(rows, size):
    """rows: (n, alone, units); the unit each row is in or begins with."""
    out, open_, begun = [], size, 0
    for n, alone, units in rows:
        if alone:
            out.append(begun)
            open_, begun = size, begun + units
        elif open_ < size and open_ + n <= size:
            out.append(begun - 1)
            open_ += n
        else:
            out.append(begun)
            open_, begun = n, begun + 1
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
def test_greedy_units(spark, block):
    r = random.Random(block)
    docs = {d: [(n, alone, r.randint(1, 3) if alone else 1) for n, alone in ((r.randint(0, 12), r.random() < 0.1) for _ in range(r.choice([1, 2, 40])))] for d in [*range(12), None]}
    rows = [(d, i, *x) for d, xs in docs.items() for i, x in enumerate(xs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, seq long, n int, alone boolean, units int")
    got = {}
    for x in sequences.greedy_units(df, "id", 12, block).orderBy("id", "seq").collect():
        got.setdefault(x.id, []).append(x.first)
    assert got == {d: units_of(xs, 12) for d, xs in docs.items()}
    assert sequences.greedy_units(df.limit(0), "id", 12, block).collect() == []


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_running_sums_totals_and_the_next_row(spark, block):
    r = random.Random(7)
    docs = {d: sorted(r.sample(range(100), r.choice([1, 5, 30]))) for d in [*range(8), None]}
    rows = [(d, s, r.randint(-5, 50)) for d, xs in docs.items() for s in xs]
    want = {(d, s): (sum(v for e, t, v in rows if e == d and t <= s), sum(e == d and t <= s for e, t, _ in rows)) for d, s, _ in rows}
    df = spark.createDataFrame(r.sample(rows, len(rows)), "id long, seq long, v long")
    some = sequences.running(df, "id", "seq", {"up_to": F.col("v"), "nth": F.lit(1)}, block)
    assert {(x.id, x.seq): (x.up_to, x.nth) for x in some.collect()} == want
    whole = sequences.totals(sequences.following(some, "id", "nth", "v", "next"), "id", {"most": F.max("v")}).collect()
    for x in whole:
        own = [v for e, _, v in sorted(rows, key=lambda y: y[1]) if e == x.id]
        assert (x.most, x.next) == (max(own), own[x.nth] if x.nth < len(own) else None)


def test_words_of_a_text_in_blocks(spark):
    for n in (0, 1, 7, 8, 9, 100):
        words = [f"w{'x' * (i % 5)}" for i in range(n)]
        df = spark.createDataFrame([(words,)], "w array<string>")
        got = df.select(F.explode(sequences.in_blocks(F.col("w"), lambda w: F.length(w).cast("long"), 8)).alias("b")).select("b.*").collect()
        assert [w for b in got for w in b["items"]] == words
        for b in got:
            assert (b.before, b.total) == (sum(map(len, words[: b.first])), sum(map(len, words)))


def test_align_of_a_clip_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "ROWS", 5)
    words = [f"parola{'a' * (i % 7)}" for i in range(53)]
    got = reading.aligned_words(spark.createDataFrame([(1, " ".join(words), 20.0), (2, "", 3.0), (3, None, 1.0), (4, "una", 2.0)], "clip_id long, text string, duration double")).orderBy("clip_id", "pos").collect()
    total, up_to = sum(map(len, words)), 0
    one = [x for x in got if x.clip_id == 1]
    assert [x.word for x in one] == words and [x.pos for x in one] == list(range(53))
    for x in one:
        assert x.start == pytest.approx(20 * up_to / total, abs=6e-4)
        up_to += len(x.word)
        assert x.end == pytest.approx(20 * up_to / total, abs=6e-4)
    assert [(x.clip_id, x.word, x.start, x.end) for x in got if x.clip_id > 1] == [(4, "una", 0.0, 2.0)]


def test_a_long_document_is_many_tasks_and_no_slower_a_sentence(spark):
    def units(n):
        rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("seq"), F.concat(F.lit("a b c "), F.repeat(F.lit("x "), (F.col("id") % 4).cast("int"))).alias("sentence"), F.lit(False).alias("placeholder"), F.lit(False).alias("failed"))
        begin = time.time()
        assert reading.playback_units(rows).count() == n
        return time.time() - begin

    units(5_000)
    short = min(units(5_000) for _ in range(2))
    assert min(units(40_000) for _ in range(2)) < 3 * short + 1  # eight times the sentences
    words = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit(0).alias("page"), F.lit("fine.").alias("text"), *(F.lit(0.1).alias(c) for c in ("x0", "y0", "x1", "y1")))
    assert reading.layout_sentences(words).count() == 20_000
    plan = reading.layout_sentences(words)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan
