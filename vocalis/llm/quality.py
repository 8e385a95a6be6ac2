"""Host-level quality rules, in DataFrame functions only.

Each document gets base counts and rule failures. Failures are summed by host, each host's rate
for each rule is shrunk to the corpus by a beta prior whose moments come from the hosts themselves,
and a host whose shrunk rate is too high for some rule is refused; its verdict goes back to its
documents by a join on the host. Sums by host are combined before they are shuffled. The verdicts of
up to MOST_BROADCAST hosts travel to the documents; a longer table joins as an ordinary side, whose
skewed hosts are split at run time. A host with a third of all documents costs no more than the rest.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows
count as often as they stand; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common

SYMBOLS = "#*$%&|<>"
#: Hosts up to which their verdicts are broadcast; beyond, they join as an ordinary side.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 50
    max_dup_line_percent: int = 50
    max_host_rate: float = 0.5
    max_strength: float = 1e6


def _n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that a text has twice or more: windows sorted by hash with their
    position, those beside an equal hash, then the length of the union of what they cover."""
    windows = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0))
    )

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                    lambda x: x["i"],
                )
            )

        def union(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda n, x: n + x,
            )

        return common.let(common.let(by_hash, starts), union)

    return common.let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def signals(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, common.SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, common.SPACE, "")) > 0)

    def of(w: Column) -> Column:
        return common.let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(bare).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _n_repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    return common.let(common.words(text), of)


def failures(s: Column, rules: Rules) -> dict[str, Column]:
    n = s["n_words"]
    return {
        "base": (n < rules.min_words) | (100 * s["n_repeat_words"] > rules.max_repeat_percent * n),
        "symbols": 100 * s["n_symbols"] > rules.max_symbols_per_100_words * n,
        "lines": 100 * s["n_dup_lines"] > rules.max_dup_line_percent * s["n_lines"],
    }


def beta_prior(n_all: int, n_hosts: int, k_all: int, q: float, max_strength: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) by moments: k_all of n_all documents fail in n_hosts hosts, and
    q is the sum of their squared failures over their documents. No spread beyond chance: full strength."""
    if not n_all:
        return 0.0, max_strength
    mean = k_all / n_all
    between = q / n_all - mean * mean - mean * (1 - mean) * n_hosts / n_all
    return mean, max(1.0, min(max_strength, mean * (1 - mean) / between - 1)) if between > 0 else max_strength


def host_verdicts(failed: DataFrame, host: str, rules: list[str], max_rate: float, max_strength: float) -> DataFrame:
    """failed: a row per document with host and a boolean per rule. Returns host, n_documents,
    rate_<rule> (posterior means) and refused."""
    by_host = failed.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_documents"), *(F.count_if(F.col(r)).alias(f"k_{r}") for r in rules)
    )
    n = F.col("n_documents")
    total = by_host.agg(
        F.sum(n).alias("n_all"),
        F.count(F.lit(1)).alias("n_hosts"),
        *(F.sum(f"k_{r}").alias(f"k_{r}") for r in rules),
        *(F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"q_{r}") for r in rules),
    ).first()  # one row of sums
    both = by_host
    for r in rules:
        mean, strength = beta_prior(total["n_all"] or 0, total["n_hosts"], total[f"k_{r}"] or 0, total[f"q_{r}"] or 0.0, max_strength)
        both = both.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(mean * strength)) / (n + F.lit(strength)))
    refused = F.greatest(*(F.col(f"rate_{r}") for r in rules), F.lit(0.0)) > max_rate
    return both.select(host, "n_documents", *(f"rate_{r}" for r in rules), refused.alias("refused"))


def judge(docs: DataFrame, text: str, host: str, rules: Rules = Rules(), keep: list[str] | None = None, scratch: common.Scratch | None = None) -> DataFrame:
    """The columns of docs named in keep (all by default) in a struct `row`, with `signals`,
    `base_failed`, `rates` (the host's, by rule) and `kept`. Counts are made once: what follows
    reads them back from a written table."""
    keep = docs.columns if keep is None else keep
    scratch = common.scope(docs, scratch)
    counted = docs.select(
        F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(host).alias("host"), signals(F.col(text)).alias("signals")
    )
    counted = scratch.write(counted, "quality")
    failed = failures(F.col("signals"), rules)
    names = list(failed)
    counted = counted.select("*", *(v.alias(k) for k, v in failed.items()))
    hosts = host_verdicts(counted.select("host", *names), "host", names, rules.max_host_rate, rules.max_strength)
    hosts = scratch.write(hosts.withColumnRenamed("host", "of_host"), "hosts")
    if hosts.count() <= MOST_BROADCAST:  # then documents needn't be dealt by host, a third of them to one
        hosts = F.broadcast(hosts)
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").select(
        "row",
        "signals",
        F.col("base").alias("base_failed"),
        F.struct(*(f"rate_{r}" for r in names)).alias("rates"),
        (~F.col("base") & ~F.col("refused")).alias("kept"),
    )


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), scratch: common.Scratch | None = None) -> DataFrame:
    """The documents that are kept, with the columns that docs has."""
    return judge(docs, text, host, rules, scratch=scratch).filter("kept").select("row.*")
