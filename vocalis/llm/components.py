"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step sends every node's smallest neighbour to its neighbours. Smallest neighbours are found by
an aggregate that is combined before it is shuffled, and joined back to the links, so that a node
with very many links isn't gathered into one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common


def _star(links: DataFrame, large: bool, scratch: common.Scratch) -> DataFrame:
    """links: u > v. Large star: a node's larger neighbours are linked with the smallest node beside
    it; small star: its smaller neighbours are."""
    if large:
        links = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that the join deals both sides itself and can split a node with very many links
    least = scratch.write(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    both = links.join(least, "u")
    if large:
        out = both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: common.Scratch | None = None) -> DataFrame:
    """node, component (its smallest node) for every node that has a link."""
    scratch = common.scope(links, scratch)
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = scratch.write(now, "links")
    seen = None
    while True:
        now = scratch.write(_star(_star(now, True, scratch), False, scratch), "links")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
