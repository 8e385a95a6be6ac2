"""Ordered rows of one document, a block of them at a time: running sums and greedy cuts by many tasks.

A window over a document is one task, however long the document is. Here rows are dealt out by (document,
block): what happens before a block comes from a row for each block. Documents of one block need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: by position for running sums, and of a block that is folded in one row.
ROWS, FOLDED = 4096, 512


def running(rows: DataFrame, id_col: str, seq: str, sums: dict[str, Column], rows_a_block: int = ROWS) -> DataFrame:
    """Adds a column for each of sums: the sum up to and with the row, in order of seq, whole numbers that
    don't repeat within a document."""
    some = rows.withColumns({"_block": F.floor(F.col(seq) / rows_a_block).cast("long"), **{f"_{c}": v for c, v in sums.items()}})
    blocks = some.groupBy(F.col(id_col).alias("_id"), F.col("_block").alias("_b")).agg(*(F.sum(f"_{c}").alias(f"_s_{c}") for c in sums))
    earlier = Window.partitionBy("_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # a document's first block has nothing before it
    before = blocks.select("_id", "_b", *(F.sum(f"_s_{c}").over(earlier).alias(f"_before_{c}") for c in sums)).filter(f"_before_{next(iter(sums))} is not null")
    here = Window.partitionBy(id_col, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    both = some.select("*", *(F.sum(f"_{c}").over(here).alias(c) for c in sums))
    both = both.join(before, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_block") == F.col("_b")), "left")
    return both.select(*rows.columns, *((F.col(c) + F.coalesce(f"_before_{c}", F.lit(0))).alias(c) for c in sums))


def totals(rows: DataFrame, id_col: str, sums: dict[str, Column]) -> DataFrame:
    """rows with aggregates of their whole document: a row for each is joined, no document is gathered."""
    whole = rows.groupBy(F.col(id_col).alias("_id")).agg(*(v.alias(c) for c, v in sums.items()))
    return rows.join(whole, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")


def following(rows: DataFrame, id_col: str, number: str, value: str, to: str) -> DataFrame:
    """Adds value of the row whose number, gapless within a document, is the next one; null at the end."""
    after = rows.select(F.col(id_col).alias("_id"), (F.col(number) - 1).alias("_n"), F.col(value).alias(to))
    return rows.join(after, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(number) == F.col("_n")), "left").drop("_id", "_n")


def greedy_units(rows: DataFrame, id_col: str, size: int, rows_a_block: int = FOLDED) -> DataFrame:
    """rows: id, seq, n, alone, units. Numbers each document's units in order of seq: rows are put together
    while their sum of n is at most size and was below it; a row that stands alone makes `units` units of
    its own. Adds first, the unit that the row is in or begins with.

    All that a unit needs of the rows before it is the open unit's sum, from 0 to size (size: nothing can
    join). A block is therefore a function from such a state to another and to a number of units begun:
    small tables, one for each block, which are composed in order of the blocks."""
    block = F.floor(F.col("seq") / rows_a_block).cast("long")
    blocks = rows.groupBy(id_col, block.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("seq", "n", "alone", "units"))).alias("_x"))
    joins = lambda open_, r: ~r["alone"] & (open_ < size) & (open_ + r["n"] <= size)
    then = lambda open_, r: F.when(r["alone"], size).when(joins(open_, r), open_ + r["n"]).otherwise(r["n"]).cast("int")
    begun = lambda open_, r: F.when(r["alone"], r["units"]).when(joins(open_, r), 0).otherwise(1).cast("long")
    state = lambda open_, n: F.struct(open_.cast("int").alias("open"), n.cast("long").alias("n"))

    every = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda s: state(s, F.lit(0)))
    table = F.aggregate("_x", every, lambda all_, r: F.transform(all_, lambda s: state(then(s["open"], r), s["n"] + begun(s["open"], r))))
    # blocks of documents that have more than one, with their tables; the block's own state is found by folding those before
    several = blocks.select(F.col(id_col).alias("_id"), F.col("_block").alias("_b"), table.alias("_t")).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_b", "_t"))).alias("_all")).filter(F.size("_all") > 1)

    def enter(so_far: Column, b: Column) -> Column:
        """so_far: state before each block up to this one."""
        last = F.element_at(so_far, -1)
        out = F.get(b["_t"], last["open"])
        return F.concat(so_far, F.array(state(out["open"], last["n"] + out["n"])))

    entries = F.aggregate("_all", F.array(state(F.lit(size), F.lit(0))), enter)
    known = several.select("_id", F.explode(F.arrays_zip(F.col("_all._b").alias("_b"), F.slice(entries, 1, F.size("_all")).alias("_s"))).alias("_z")).select("_id", "_z.*")
    both = blocks.join(known, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_block") == F.col("_b")), "left")

    def number(so_far: Column, r: Column) -> Column:
        s = so_far["s"]
        new = begun(s["open"], r)
        # a row that joins is in the last unit begun; a row that begins some is in the first of them
        first = F.when(new == 0, s["n"] - 1).otherwise(s["n"])
        return F.struct(state(then(s["open"], r), s["n"] + new).alias("s"), F.concat(so_far["at"], F.array(first)).alias("at"))

    start = F.struct(F.coalesce("_s", state(F.lit(size), F.lit(0))).alias("s"), F.array().cast("array<bigint>").alias("at"))
    found = both.select(id_col, F.explode(F.arrays_zip("_x", F.aggregate("_x", start, number, lambda s: s["at"]).alias("_at"))).alias("_z"))
    return found.select(id_col, "_z._x.*", F.col("_z._at").alias("first"))


def in_blocks(items: Column, weight, rows_a_block: int = FOLDED) -> Column:
    """An array cut into blocks: an array of structs with first (the index of its first item), before (the
    sum of weights before it), total (of the whole array) and items. weight: a function from an item to a long."""

    def cut(x: Column) -> Column:
        n = F.ceil(F.size(x) / rows_a_block).cast("int")
        parts = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), 1, n), lambda b: F.struct((b * rows_a_block).alias("first"), F.slice(x, b * rows_a_block + 1, F.lit(rows_a_block)).alias("items")))
        summed = F.transform(parts, lambda p: F.struct(p["first"].alias("first"), p["items"].alias("items"), F.aggregate(p["items"], F.lit(0).cast("long"), lambda a, i: a + weight(i)).alias("sum")))

        def with_before(all_: Column) -> Column:
            starts = F.aggregate(all_, F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["sum"])))
            block = lambda s, p, i: F.struct(p["first"].alias("first"), F.get(s, i).alias("before"), F.element_at(s, -1).alias("total"), p["items"].alias("items"))
            return F.element_at(F.transform(F.array(starts), lambda s: F.transform(all_, lambda p, i: block(s, p, i))), 1)

        return F.element_at(F.transform(F.array(summed), with_before), 1)

    return F.element_at(F.transform(F.array(items), cut), 1)
