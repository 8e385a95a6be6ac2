"""From documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import weakref
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm import common, line_dedup, minhash, mixing, packing, quality


#: Results of stages that were called without a scope, with the tables that they read.
_results: list[tuple[weakref.ref, common.Scratch]] = []


def _scoped(stage):
    """The stage with scratch tables of its own, if it isn't given a scope. Such tables go when a later
    stage begins, once nobody holds the result any more and the later stage doesn't read them: whoever
    uses a frame made from a result keeps the result, or gives a scope."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: common.Scratch | None = None) -> DataFrame:
        if scratch:
            return stage(spark, docs, sf_dir, scratch)
        for result, scope in [x for x in _results if x[0]() is None and not x[1].holds(docs)]:
            _results.remove((result, scope))
            scope.close()
        own = common.Scratch(spark)
        out = stage(spark, docs, sf_dir, own)
        _results.append((weakref.ref(out), own))
        return out

    return run_stage


@_scoped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: common.Scratch) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go. A null or empty text has no
    words and goes; a null host is a host; repeated rows stay; of no documents none are left."""
    return quality.quality_filter(docs, scratch=scratch)


@_scoped
def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: common.Scratch) -> DataFrame:
    """Later copies of repeated line runs go, with documents of which no word is left. A null text
    stays null; rows with one id and text are one document and keep the same lines; whole texts count."""
    out = line_dedup.deduplicated(docs, scratch=scratch)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


@_scoped
def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: common.Scratch) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, similarity of
    0.8 or more. Texts without words and null ids are of no group and stay; so do all rows of an id."""
    return minhash.near_dedup(docs, scratch=scratch)


@_scoped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: common.Scratch) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are not taken, and null
    is a source, the last; rows of one id and size are taken or left together; whole texts count; of no
    documents none are taken."""
    return mixing.mixed(docs, scratch=scratch)


@_scoped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: common.Scratch) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a document that was taken twice, or stands twice,
    is packed twice; a null text is its end id; very long texts are cut at multiples of 2048; of no
    documents there are no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch=scratch)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines_deduplicated),
    ("near dedup", near_deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Signatures, seeded draws and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents table. A stage's result and scratch tables go once the next stage's
    result stands, those that the returned frame reads when the driver ends; other runs, at the same time
    or later, have tables of their own. The stages say what becomes of odd rows; no documents, no pieces."""
    docs, last = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES[:-1]:
        result = common.Scratch(spark)
        with common.Scratch(spark) as scratch:
            docs = result.write(stage(spark, docs, sf_dir, scratch), name.replace(" ", "-"))
        last.close()
        last = result
    out = STAGES[-1][1](spark, docs, sf_dir, common.Scratch(spark))
    last.close()  # packing has read it
    return out
