"""A Merkle manifest of a dataset: a tree of digests by part, a tree of the parts' roots, and proofs.

Leaves are ordered by a range shuffle of their narrow columns and numbered from counts by range. The trees are
built by combineByKey over blocks of leaves. A block's combiner takes digests as events, in any order: each
adds an indexed child to its partial parent; once the parent has the number of children that the tree's size
gives it, its own digest is an event for its parent in turn. What a partition can't complete, the frontier of
partial parents, goes on to the shuffle with the block and is completed by the merge. A round makes the roots
of all blocks, which are the leaves of the next round: rounds grow with the logarithm of the leaves, by 1,024
a round. The nodes of each block are kept as reverse links from a parent to its children: from the top block
down, each block's way to the root is joined by (part, block), and proofs are put together inside blocks.

No key holds more than a block, so a part of a third of all rows is as good as any. Each round is a table in
the shared folder.

Defined results: rows of one id are ordered by their leaf, equal rows are leaves each, a null id comes first,
a null part is a part of its own and first; null values have a mark of their own in a leaf, unlike the empty
text; very long texts count whole; an empty table gives an empty manifest; columns of clashing names don't
matter.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm import common

#: Children of a node, and levels that a round climbs.
ARITY, CLIMB = 2, 10

STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
KEY = [T.StructField("part", T.StringType()), T.StructField("block", T.LongType())]
WAY = T.ArrayType(STEP)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)).cast("binary"), 256)


def parent_digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def nodes_at(n: int, level: int) -> int:
    return -(-n // ARITY**level)


class Partial:
    """Part of a block: digests known so far by (level, index), partial parents, and the rows of leaves."""

    __slots__ = ("n", "nodes", "waiting", "rows")

    def __init__(self, n: int):
        self.n, self.nodes, self.waiting, self.rows = n, {}, {}, {}

    def event(self, level: int, index: int, digest: str) -> None:
        while True:
            self.nodes[level, index] = digest
            if level == CLIMB or nodes_at(self.n, level) == 1:
                return
            up = index // ARITY
            arity = min(ARITY, nodes_at(self.n, level) - up * ARITY)
            children = self.waiting.setdefault((level + 1, up), {})
            children[index] = digest
            if len(children) < arity:
                return
            del self.waiting[level + 1, up]
            level, index, digest = level + 1, up, parent_digest([children[i] for i in sorted(children)])

    def add(self, leaf: tuple) -> "Partial":
        _, index, digest, row = leaf
        self.rows[index] = row
        self.event(0, index, digest)
        return self

    def merge(self, other: "Partial") -> "Partial":
        self.rows.update(other.rows)
        self.nodes.update(other.nodes)
        for (level, _), children in other.waiting.items():
            for index, digest in children.items():
                self.event(level - 1, index, digest)
        return self

    def way(self, index: int) -> list[tuple[str, str]]:
        """From a leaf to the block's root: the digests before and after the node in its run, by level."""
        out, level = [], 0
        while level < CLIMB and (here := nodes_at(self.n, level)) > 1:
            first = index - index % ARITY
            run = [self.nodes[level, i] for i in range(first, min(first + ARITY, here))]
            out.append(("".join(run[: index - first]), "".join(run[index - first + 1 :])))
            level, index = level + 1, index // ARITY
        return out


def _new(leaf: tuple) -> Partial:
    return Partial(leaf[0]).add(leaf)


def _ranked(df: DataFrame, part: Column, order: list[Column], scratch: common.Scratch) -> DataFrame:
    """Adds index, from 0 in each part in this order, and n, the part's rows. df: a written table."""
    keyed = df.withColumn("_part", part)
    key = ["_part", *order]
    ranged = keyed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    ranged = scratch.write(ranged, "merkle-order").withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy("_part", "_range").agg(F.count(F.lit(1)).alias("m"), F.min("_at").alias("first"))
    whole = Window.partitionBy("_part")
    starts = counts.select(
        F.col("_part").alias("p"),
        F.col("_range").alias("r"),
        "first",
        F.sum("m").over(whole).alias("n"),
        (F.sum("m").over(whole.orderBy("_range")) - F.col("m")).alias("before"),
    )
    starts = scratch.write(starts, "merkle-starts")
    both = ranged.join(starts, common.same(F.col("_part"), F.col("p")) & (F.col("_range") == F.col("r")))
    return both.select(*df.columns, (F.col("_at") - F.col("first") + F.col("before")).alias("index"), "n")


def _climb(leaves: DataFrame, scratch: common.Scratch) -> tuple[list[DataFrame], DataFrame]:
    """leaves: part, n, index, digest, row (any struct). Returns the rounds' tables (part, block, n, nodes,
    rows) and a table of the roots (part, digest)."""
    spark, rounds = leaves.sparkSession, []
    most = leaves.agg(F.max("n")).first()[0] or 1
    width, tasks = ARITY**CLIMB, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not rounds or most > 1:
        row_type = leaves.schema["row"].dataType
        node = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("index", T.LongType()), T.StructField("digest", T.StringType())])
        row = T.StructType([T.StructField("index", T.LongType()), T.StructField("row", row_type)])
        table = T.StructType([*KEY, T.StructField("n", T.LongType()), T.StructField("nodes", T.ArrayType(node)), T.StructField("rows", T.ArrayType(row)), T.StructField("digest", T.StringType())])
        # indices within a block start at 0 only for the first; levels keep the tree's own indices
        events = leaves.select("part", "n", "index", "digest", "row").rdd.map(lambda r: ((r[0], r[2] // width), (r[1], r[2], r[3], r[4])))
        blocks = events.combineByKey(_new, Partial.add, Partial.merge, tasks).map(_block_row)
        blocks = scratch.write(spark.createDataFrame(blocks, table, verifySchema=False), "merkle-blocks")
        rounds.append(blocks)
        up = F.ceil(F.col("n") / width).cast("long").alias("n")
        leaves = blocks.select("part", up, F.col("block").alias("index"), "digest", F.lit(None).cast("string").alias("row"))
        most = nodes_at(most, CLIMB)
    return rounds, leaves.select("part", "digest")


def _block_row(item: tuple) -> tuple:
    (part, block), p = item
    top = max(p.nodes)  # the highest level has one node of this block
    return part, block, p.n, [(level, i, d) for (level, i), d in p.nodes.items()], list(p.rows.items()), p.nodes[top]


def _partial(block) -> Partial:
    p = Partial(block.n)
    p.nodes = {(level, i): d for level, i, d in block.nodes}
    return p


def _down(blocks: DataFrame, above: DataFrame, each, schema: T.StructType) -> DataFrame:
    """each(index, digest, row, way to the root, top) for every leaf of the blocks, where above has the way
    of each block's root and its part's `top`."""
    above = above.select(F.col("part").alias("p"), F.col("block").alias("b"), "way", "top")
    both = blocks.join(above, common.same(F.col("part"), F.col("p")) & (F.col("block") == F.col("b")))

    def leaves(block):
        p, way, top = _partial(block), [tuple(s) for s in block.way], block.top
        for index, row in block.rows:
            yield each(block.part, index, p.nodes[0, index], row, p.way(index) + way, top)

    rows = both.select("part", "block", "n", "nodes", "rows", "way", "top").rdd.flatMap(leaves)
    return blocks.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def _descend(rounds: list[DataFrame], tops: DataFrame, each, schema: T.StructType, scratch: common.Scratch) -> DataFrame:
    """tops: part, way, top. From the last round to the first."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    link = T.StructType([*KEY, T.StructField("way", WAY), T.StructField("top", tops.schema["top"].dataType)])
    for blocks in reversed(rounds[1:]):
        above = scratch.write(_down(blocks, above, lambda part, index, digest, row, way, top: (part, index, way, top), link), "merkle-ways")
    return _down(rounds[0], above, each, schema)


def folded(digest: str, way: list[tuple[str, str]]) -> str:
    for before, after in way:
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


def proof_digest(way: list[tuple[str, str]]) -> str:
    return sha256("".join(b + a for b, a in way).encode()).hexdigest()


def manifest(docs: DataFrame, id: str, part: str, leaf: Column, changed: Column, scratch: common.Scratch | None = None) -> DataFrame:
    """leaf: the digest of a row; changed: another digest to hold against the manifest, or null for the
    row's own. For each row: id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    common.ship(docs.sparkSession)
    scratch = common.scope(docs, scratch)
    id_type = docs.schema[id].dataType
    # a mark before each part's name leaves the empty one to null, which comes first
    narrow = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("")).alias("part"),
        leaf.alias("digest"),
        F.struct(F.col(id).alias("id"), changed.alias("changed")).alias("row"),
    )
    narrow = scratch.write(narrow, "merkle-leaves")
    rounds, roots = _climb(_ranked(narrow, F.col("part"), [F.col("row.id"), F.col("digest")], scratch), scratch)
    roots = scratch.write(roots, "merkle-subroots")
    subroots = roots.select(F.lit("").alias("part"), "digest", F.struct(F.col("part").alias("of")).alias("row"))
    subroots = _ranked(subroots, F.col("part"), [F.col("row.of")], scratch)
    upper, root = _climb(subroots, scratch)
    one = root.select("part", F.array().cast(WAY).alias("way"), F.col("digest").alias("top"))
    top = T.StructType([T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])
    tops = T.StructType([T.StructField("part", T.StringType()), T.StructField("way", WAY), T.StructField("top", top)])
    ways = _descend(upper, one, lambda part, index, digest, row, way, root: (row.of, way, (digest, root)), tops, scratch)
    out = T.StructType([T.StructField(id, id_type), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])

    def judged(part, index, digest, row, way, top):
        found = folded(row.changed or digest, way)
        return row.id, digest, top.subroot, top.root, proof_digest(way), found, found == top.root

    return _descend(rounds, scratch.write(ways, "merkle-tops"), judged, out, scratch)
