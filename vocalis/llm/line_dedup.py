"""Repeated runs of lines, in DataFrame functions only.

The corpus is read as sequences of line ids (128 bits of the trimmed line; lines without a word are
passed over). Prefix doubling names the suffixes: the name of a suffix at depth 1, 2, 4, ... lines is
the first suffix, by document and line, that begins with the same run. A round pairs each name with
the name as many lines further on (a range frame within the document, so no join) and finds the first
suffix of each pair by an aggregate that is combined before it is shuffled. Suffixes whose run occurs
once drop out after each round, so rounds shrink.

Every suffix has a least depth: the lines after which its run has min_words words. Suffixes that share
a prefix of some depth are an interval of the suffix array, a common-prefix interval, and its first
member stays: at all others the run is a later copy. Intervals are looked at from a suffix's least depth
up to the next suffix's least depth (or the text's end): a maximal repeated run's last suffix of
min_words words reaches the run's end by one of these depths, and the suffixes before it cover the rest,
so the union of what intervals cover is the maximal repeated runs whole. There are about two depths a
line in all, and depths never exceed min_words, so rounds never exceed its logarithm. Names stand for
ranks: an interval needs only to know which suffixes are equal and which is first. Without whole_runs a
suffix is judged at its least depth alone, and last lines with under min_words words together stay.

Defined results: a null text has no lines and stays null; lines without words stay; rows with the same
id and text are one document (neither is the other's later copy); rows with one id and different texts
are ordered by a hash of the text; null ids come first; an empty table gives an empty table; other
columns pass through, whatever their names; very long texts are read whole, line by line, and a line's
identity is 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm import common

MIN_WORDS = 20


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(F.translate(line, common.SPACE, " " * len(common.SPACE)), " "), ""))


def _lines(text: Column, min_words: int, whole_runs: bool) -> Column:
    """Array of (i: line number, a, b: id, depth: least depth or null, most: greatest depth) of the lines with a word."""
    trimmed = lambda x: F.btrim(x, F.lit(common.SPACE))
    every = F.transform(
        F.split(text, "\n"),
        lambda x, i: common.let(
            trimmed(x), lambda t: F.struct(i.alias("i"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"), _n_words(t).alias("w"))
        ),
    )

    def depth(some: Column, e: Column, i: Column) -> Column:
        so_far = F.aggregate(
            F.slice(some, i + 1, F.lit(min_words)),
            F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")),
            lambda s, x: F.when(s["w"] >= min_words, s).otherwise(F.struct((s["w"] + x["w"]).alias("w"), (s["n"] + 1).alias("n"))),
        )
        return F.when(e["w"] >= min_words, 1).otherwise(common.let(so_far, lambda s: F.when(s["w"] >= min_words, s["n"])))

    def most(at: Column, i: Column) -> Column:
        return F.greatest(F.get(at, i)["depth"], F.coalesce(F.get(at, i + 1)["depth"], F.size(at) - i)) if whole_runs else F.get(at, i)["depth"]

    with_depth = common.let(
        F.filter(every, lambda x: x["w"] > 0),
        lambda some: F.transform(some, lambda e, i: F.struct(e["i"], e["a"], e["b"], depth(some, e, i).alias("depth"))),
    )
    return common.let(with_depth, lambda at: F.transform(at, lambda e, i: F.struct(e["i"], e["a"], e["b"], e["depth"], most(at, i).alias("most"))))


def later_copies(docs: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS, whole_runs: bool = True, scratch: common.Scratch | None = None) -> DataFrame:
    """d (id), h (hash of the text), i (line number) of each line that a later copy covers."""
    body, scratch = F.col(text), common.scope(docs, scratch)
    lines = docs.filter(body.isNotNull()).select(F.col(id_col).alias("d"), F.xxhash64(body).alias("h"), F.posexplode(_lines(body, min_words, whole_runs)).alias("p", "e"))
    lines = scratch.write(lines.select("d", "h", "p", "e.*"), "lines")
    here = F.struct("d", "h", "p")
    named = lines.groupBy("a", "b").agg(F.min(here).alias("name"), F.max(here).alias("last")).filter("name <> last").select("a", "b", "name")
    suffixes = scratch.write(lines.join(named, ["a", "b"]).select("d", "h", "p", "i", "depth", "most", "name"), "suffixes")
    deepest = suffixes.filter("depth is not null").agg(F.max("most")).first()[0] or 0

    copies = suffixes.filter("depth = 1").filter(here != F.col("name")).select("d", "h", "p", "depth")
    k, at = 1, suffixes.select("d", "h", "p", "depth", "most", "name")
    while 2 * k <= deepest:
        ahead = Window.partitionBy("d", "h").orderBy("p").rangeBetween(k, k)
        pairs = at.withColumn("then", F.first("name").over(ahead)).filter("then is not null")
        firsts = pairs.groupBy("name", "then").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first <> last")
        at = scratch.write(
            pairs.join(firsts, ["name", "then"]).select("d", "h", "p", "depth", "most", F.col("first").alias("name")), f"suffixes-{2 * k}"
        )
        k *= 2
        # runs of k to 2k - 1 lines: two runs of k lines that overlap
        depths = F.sequence(F.greatest("depth", F.lit(k)), F.least("most", F.lit(2 * k - 1)))
        begin = at.filter((F.col("most") >= k) & (F.col("depth") < 2 * k)).withColumn("depth", F.explode(depths)).withColumn("q", F.col("p") + F.col("depth") - k)
        end = at.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("p").alias("q"), F.col("name").alias("until"))
        runs = begin.join(end, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (begin["q"] == end["q"]))
        runs = runs.select("d", "h", "p", "depth", "name", "until")
        firsts = runs.groupBy("name", "until", "depth").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first <> last")
        copies = copies.union(runs.join(firsts, ["name", "until", "depth"]).filter(here != F.col("first")).select("d", "h", "p", "depth"))
    covered = copies.select("d", "h", F.explode(F.sequence("p", F.col("p") + F.col("depth") - 1)).alias("p")).distinct()
    return (
        covered.withColumnRenamed("d", "d2")
        .withColumnRenamed("h", "h2")
        .withColumnRenamed("p", "p2")
        .join(suffixes.select("d", "h", "p", "i"), F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("p") == F.col("p2")))
        .select("d", "h", "i")
        .distinct()
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, keep: list[str] | None = None, whole_runs: bool = True, scratch: common.Scratch | None = None) -> DataFrame:
    """`row` (struct of the columns in keep, all by default, with the text that is left), n_lines,
    n_removed and n_spans (maximal runs of lines removed; lines without words don't end one)."""
    keep = docs.columns if keep is None else keep
    gone = later_copies(docs, id_col, text, min_words, whole_runs, scratch)
    gone = gone.groupBy("d", "h").agg(F.sort_array(F.collect_set("i")).alias("gone"))
    base = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("all"))
    lines = F.split(F.col(f"all.{text}"), "\n")
    both = base.join(gone, F.col(f"all.{id_col}").eqNullSafe(F.col("d")) & (F.xxhash64(F.col(f"all.{text}")) == F.col("h")), "left")

    def left_over(ls: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")

    def spans(ls: Column) -> Column:
        """Removed lines before which the nearest line with a word stays: one walk along lines and `gone`."""
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("in"), F.lit(0).alias("n"))

        def step(s: Column, line: Column) -> Column:
            i, wordy = line["i"], line["w"]
            hit = F.coalesce(F.get("gone", s["at"]) == i, F.lit(False))
            return F.struct(
                (s["at"] + hit.cast("int")).alias("at"), F.when(wordy, hit).otherwise(s["in"]).alias("in"), (s["n"] + (wordy & hit & ~s["in"]).cast("int")).alias("n")
            )

        every = F.transform(ls, lambda x, i: F.struct(i.alias("i"), (F.length(F.btrim(x, F.lit(common.SPACE))) > 0).alias("w")))
        return F.aggregate(every, start, step, lambda s: s["n"])

    some = F.col("gone").isNotNull()
    new_text = F.when(some, common.let(lines, left_over)).otherwise(F.col(f"all.{text}"))
    return both.select(
        F.struct(*((new_text if c == text else F.col(f"all.{c}")).alias(c) for c in keep)).alias("row"),
        F.when(F.col(f"all.{text}").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(some, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, common.let(lines, spans)).otherwise(0).cast("long").alias("n_spans"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, whole_runs: bool = True, scratch: common.Scratch | None = None) -> DataFrame:
    """The columns of docs, texts without later copies; documents of which no word is left go."""
    out = line_dedup(docs, id_col, text, min_words, whole_runs=whole_runs, scratch=scratch)
    left = F.length(F.translate(F.coalesce(F.col(f"row.{text}"), F.lit("")), common.SPACE, "")) > 0
    return out.filter((F.col("n_removed") == 0) | left).select("row.*")
