"""Helpers that every operator here shares: reading, scratch tables, words, salted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.scratch import Scratch, delete, new_dir, shared_dir, tidy_writes  # noqa: F401 - operators call common.*
from vocalis.shipping import ship  # noqa: F401 - operators call common.ship

#: White space of the word contracts: space and U+0009 to U+000D. Fixed by the contracts.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scope(df: DataFrame, given: Scratch | None) -> Scratch:
    return given or Scratch(df.sparkSession)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable isn't inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
