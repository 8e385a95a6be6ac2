"""How filters interact: what each removes at each step of every order, and what only it would remove.

Words are counted relationally: texts are dealt out whole by document (a text is smaller than its rows of
words), words exploded and aggregated by (document, word), then by document into totals and distinct words;
both aggregates need no further shuffle. Joined with the other flags, each document has a set of failed
filters, one of 32. Conditional counts of those 32 sets by part give every figure of all 120 orders: the
report costs the same however many documents there are.

A document is told from others of its id by 64 bits of hash of its text; equal texts are found by SHA-256.
Equal rows in one input split meet in one task and no more do, so a repeated id is no hot key: each text
brings an empty word along, whose count says how many copies were counted. The smallest id of each repeated
text is written before it is joined, so that Spark can split the join where a third of all rows share a text.

Defined results: a null text is empty, an empty text has no words, fails A and passes B; a null part is the
empty string; repeated rows count each; the row of smallest id passes E with all rows of that id, and a null
id passes E; an id that labels name twice has a label if any row says so; very long texts count whole; an
empty table gives an empty report; columns of clashing names are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common


@dataclass(frozen=True)
class Filters:
    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 3
    symbols: str = "#$%&*|"


def word_totals(texts: DataFrame) -> DataFrame:
    """texts: id, mark, text. By id and mark: n_words and n_distinct of one copy."""
    document = ["id", "mark", "split"]
    dealt = texts.withColumn("split", F.spark_partition_id()).repartition(*document)
    words = F.concat(F.array(F.lit("")), common.words(F.col("text")))
    by_word = dealt.select(*document, F.explode(words).alias("word")).groupBy(*document, "word").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("word") != ""
    by_split = by_word.groupBy(*document).agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("all_words"),
        F.sum(F.when(~real, F.col("n")).otherwise(0)).alias("copies"),
        F.count_if(real).alias("n_distinct"),
    )
    each = by_split.groupBy("id", "mark").agg(F.sum("all_words").alias("a"), F.sum("copies").alias("c"), F.max("n_distinct").alias("n_distinct"))
    return each.select("id", "mark", F.expr("a div c").alias("n_words"), "n_distinct")


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang", how: Filters = Filters(), scratch: common.Scratch | None = None) -> DataFrame:
    """For each row of docs: id, part, and a boolean for each of the filters A to E: whether it fails."""
    scratch = common.scope(docs, scratch)
    x = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), x.alias("text"))
    base = base.withColumn("mark", F.xxhash64("text"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    flags = base.select(
        "id",
        "mark",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * capitals.cast("long") > how.max_capital_percent * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[" + "".join("\\" + c for c in how.symbols) + "]").alias("D"),
    )
    flags = scratch.write(flags, "audit-flags")
    totals = scratch.write(word_totals(base.select("id", "mark", "text")), "audit-words")
    first = flags.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = scratch.write(first.select(F.col("digest").alias("of"), "first"), "audit-firsts")
    both = flags.join(first, F.col("digest") == F.col("of"), "left").select("id", "mark", "part", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))
    counted = totals.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "n_words", "n_distinct")
    both = both.join(counted, common.same(F.col("id"), F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return both.select("id", "part", (n < how.min_words).alias("A"), (100 * distinct < how.min_distinct_percent * n).alias("B"), "C", "D", "E")


def _set_counts(failed: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """By part an array for `all` and for each loss: the number of documents of each set of failed filters."""
    mask = sum((F.col(f).cast("int") * 2**i for i, f in enumerate(filters)), F.lit(0))
    sums = failed.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col(x)).alias(x) for x in losses))
    sets = range(2 ** len(filters))
    counts = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}_{m}") for c in ["all", *losses] for m in sets]
    return sums.groupBy("part").agg(*counts).select("part", *(F.array(*(f"{c}_{m}" for m in sets)).alias(c) for c in ["all", *losses]))


def interactions(failed: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """failed: part, a boolean for each filter (a letter) and for each loss. For each part, order of the
    filters and step: kept, removed, redundant, unique_fails, <loss>_lost, shapley (the filter's removed
    documents summed over all orders)."""
    n = len(filters)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    report = _set_counts(failed, filters, losses).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(1, n + 1)))))

    def bits(letters: Column) -> Column:
        return sum((F.contains(letters, F.lit(f)).cast("int") * 2**i for i, f in enumerate(filters)), F.lit(0))

    report = report.withColumn("own", bits(F.expr("substr(filter_order, step, 1)"))).withColumn("prior", bits(F.expr("substr(filter_order, 1, step - 1)")))
    sets = F.sequence(F.lit(0), F.lit(2**n - 1))
    own, prior = F.col("own"), F.col("prior")

    # a filter comes first among the k that a document fails in one of k orders
    all_orders = factorial(n)
    shares = F.array(*(F.lit(all_orders // max(k, 1)) for k in range(n + 1)))

    def total(counts: str, where, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate(sets, F.lit(0).cast("long"), lambda a, m: a + F.when(where(m), F.get(counts, m) * times(m)).otherwise(0))

    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(prior) == 0)
    return report.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: m.bitwiseAND(own.bitwiseOR(prior)) == 0).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(prior) != 0)).alias("redundant"),
        total("all", lambda m: m == own).alias("unique_fails"),
        *(total(x, here).alias(f"{x}_lost") for x in losses),
        total("all", lambda m: m.bitwiseAND(own) != 0, lambda m: F.get(shares, F.bit_count(m))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, how: Filters = Filters(), scratch: common.Scratch | None = None) -> DataFrame:
    """The report on documents, with the good and the toxic ones that labels name."""
    failed = failures(docs, how=how, scratch=scratch)
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    failed = failed.join(known, F.col("id") == F.col("labelled"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return interactions(failed, list("ABCDE"), ["good", "toxic"])
