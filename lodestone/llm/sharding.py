"""K-d tree partitioning by DataFrame operations alone.

Each document is a point of its metadata: bytes, characters, source and language, the last two as numbers that stand for
their names. Equal texts are one point: they take the least source and language among them. A node is split along the
dimension in which it is widest against the whole table, at the weighted quantile that gives each side its share of
leaves, until leaves hold the target bytes: a given number of bytes, or the table's share of a given number of shards. All
nodes of a level are split together: sums of bytes by bin narrow each cut down, a bin at a time, so a level costs a few
aggregations whose results hold RESULT rows at most, whatever the table holds. A level's cuts are a table, which rows meet
by their node, so a tree of very many leaves is a join a level; every LEVELS of them the rows' nodes are written. Rows with one value in the cut's
dimension are ordered by their texts' CRC, so equal texts stay together; a cut goes between two of them only where the
group outweighs KEEP of a shard, and then by hash of doc_id.

Law: bytes. Sizes of shards differ by a few thousandths of a shard, or by about a document where that is more.
Defined cases: a null text has 0 bytes (size 8) and CRC 0; a null or missing source, language or n_chars counts as the
empty name or as the text's own characters; rows equal in text and doc_id can't be cut apart; an empty table gives no
rows; a table with fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BINS, KEEP, EXACT, SLOTS = 512, 0.004, 0.0005, 128
RESULT, LEVELS, SMALL = 1 << 19, 4, 1 << 18  # rows that the driver gets at once; levels between two tables; rows of a table that is broadcast
DIMS = ("size", "chars", "source", "lang")


@dataclass
class Node:
    """A box of the tree. A leaf's shard is its low; an inner node has a cut: rows with (key, hash) below it go left."""

    low: int
    high: int
    dim: str = ""
    cut: tuple[int, int] | None = None
    sides: list[Node] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return self.high - self.low


def key(dim: str) -> Column:
    """One number a row for a dimension; rows with one value are ordered by their CRC."""
    return F.shiftleft(F.least(F.col(dim), F.lit(2**31 - 1)), 32) + F.col("crc")


def named(docs: DataFrame, column: str) -> Column:
    """A number of 31 bits for a name; the empty one, null or a missing column: 0."""
    if column not in docs.columns:
        return F.lit(0).cast("long")
    name = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.shiftright(F.crc32(F.encode(name, "UTF-8")), 1).cast("long")


def table_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, made in the JVM; broadcast up to SMALL rows."""
    made = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
    return F.broadcast(made) if len(rows) <= SMALL else made


def descended(points: DataFrame, level: list[Node]) -> DataFrame:
    """Rows one level further down: a row's node is the least leaf below it."""
    cuts = [{"node": n.low, "dim": n.dim, "cut": n.cut[0], "cut_tie": n.cut[1], "middle": n.low + n.leaves // 2} for n in level]
    met = points.join(table_of(points.sparkSession, cuts, "node int, dim string, cut long, cut_tie long, middle int"), "node", "left")
    own = F.coalesce(*(F.when(F.col("dim") == d, F.col(f"key_{d}")) for d in DIMS))
    right = (own > F.col("cut")) | ((own == F.col("cut")) & (F.col("tie") >= F.col("cut_tie")))
    return met.withColumn("node", F.when(right, F.col("middle")).otherwise(F.col("node"))).select(*points.columns)


@dataclass
class Search:
    """The narrowing of one node's cut."""

    node: Node
    target: float
    exact: float
    keep: float
    before: float = 0.0
    low: int = 0
    high: int = 0
    at: int | None = None  # the key whose rows are cut by hash

    def row(self, bins: int) -> dict:
        """This search as a row of a small table."""
        return {"node": self.node.low, "dim": self.node.dim, "at": self.at, "low": self.low, "high": self.high, "step": max(1, -(-(self.high - self.low) // bins))}

    def done(self, value: int) -> None:
        self.node.cut = (value, 0) if self.at is None else (self.at, value)

    def narrow(self, bins: list[tuple[int, int, int, int]]) -> None:
        """bins: (number, bytes, least, greatest value) of the rows within [low, high), in order."""
        below = self.before
        for number, weight, least, most in bins:
            if below + weight < self.target and number != bins[-1][0]:
                below += weight
                continue
            nearer = least if self.target - below <= below + weight - self.target else most + 1
            if weight <= self.exact:
                return self.done(nearer)
            if least == most:
                if self.at is not None or weight <= self.keep:
                    return self.done(nearer)
                self.at, self.before, self.low, self.high = least, below, 0, 2**62
                return None
            self.before, self.low, self.high = below, least, most + 1
            return None
        return self.done(self.high)


def grow(points: DataFrame, shards: int, scratch: Scratch) -> tuple[Node, DataFrame]:
    """The tree over rows of DIMS, their keys and tie, and the rows with the leaf of each as `node`."""
    root, spark = Node(0, shards), points.sparkSession
    box = points.withColumn("node", F.lit(0))
    whole = points.agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("low", F.min), ("high", F.max)))).first()
    if not whole.bytes:
        return root, box
    spread = {d: max(1, whole[f"high_{d}"] - whole[f"low_{d}"]) for d in DIMS}
    leaf, depth, level = whole.bytes / shards, 0, [root]
    while level := [n for n in level if n.leaves > 1]:
        spots = {n.low: n for n in level}
        found = box.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("low", F.min), ("high", F.max))), *(f(f"key_{d}").alias(f"{n}_key_{d}") for d in DIMS for n, f in (("low", F.min), ("high", F.max)))).collect()
        searches = {}
        for r in found:
            if (node := spots.get(r.node)) is None:
                continue  # a leaf
            node.dim = max(DIMS, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / spread[d])
            share = (node.leaves // 2) / node.leaves
            searches[node.low] = Search(node, r.bytes * share, leaf * EXACT, leaf * KEEP, 0.0, r[f"low_key_{node.dim}"], r[f"high_key_{node.dim}"] + 1)
        for n in level:
            if n.low not in searches:  # no rows
                n.dim, n.cut = DIMS[0], (0, 0)
        while going := [s for s in searches.values() if s.node.cut is None]:
            bins = max(2, min(BINS, RESULT // len(going)))
            states = table_of(spark, [s.row(bins) for s in going], "node int, dim string, at long, low long, high long, step long")
            own = F.coalesce(*(F.when(F.col("dim") == d, F.col(f"key_{d}")) for d in DIMS))
            met = box.join(states, "node").withColumn("own", own)
            met = met.where(F.col("at").isNull() | (F.col("own") == F.col("at"))).withColumn("value", F.when(F.col("at").isNull(), F.col("own")).otherwise(F.col("tie")))
            met = met.where("value >= low and value < high").withColumn("bin", F.expr("(value - low) div step"))
            counted: dict[int, list[tuple[int, int, int, int]]] = {}
            for r in met.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("value").alias("least"), F.max("value").alias("most")).collect():
                counted.setdefault(r.node, []).append((r.bin, r.bytes, r.least, r.most))
            for s in going:
                s.narrow(sorted(counted.get(s.node.low, [])))
        box, depth = descended(box, level), depth + 1
        box = scratch.table(box, f"level-{depth}") if depth % LEVELS == 0 else box
        for n in level:
            middle = n.low + n.leaves // 2
            n.sides = [Node(n.low, middle), Node(middle, n.high)]
        level = [s for n in level for s in n.sides]
    return root, box


def points_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, size, chars, source, lang, crc, tie) of every row; texts are read once, later passes read these numbers alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.char_length(text).cast("long").alias("chars"), named(docs, "source").alias("source"), named(docs, "lang").alias("lang"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("tie"),
    )
    own = scratch.table(own, "own")
    # Equal texts have one size and CRC. Written, so that a hot text's join may be split.
    groups = own.groupBy("crc", "size").agg(F.min("source").alias("first_source"), F.min("lang").alias("first_lang"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    held = own.join(scratch.table(groups, "groups"), ["crc", "size"], "left")
    return held.select("doc_id", "size", "chars", F.coalesce("first_source", "source").alias("source"), F.coalesce("first_lang", "lang").alias("lang"), "crc", "tie")


def shard(docs: DataFrame, shards: int = 24, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; target_bytes: of a shard, in place of their number."""
    scratch = Scratch(docs.sparkSession, "shards")
    points = points_of(docs, scratch)
    points = points.select("*", *(key(d).alias(f"key_{d}") for d in DIMS))
    points = scratch.table(points, "points")
    if target_bytes:
        shards = max(1, -(-(points.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = grow(points, shards, scratch)[1].withColumnRenamed("node", "shard").withColumn("lot", F.pmod("tie", F.lit(SLOTS)))
    # Slots: each shard's rows are dealt into lots by hash, numbered within a lot, and shifted by the lots before.
    lots = placed.groupBy("shard", "lot").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = lots.select("shard", "lot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("doc_id", "crc"))
    numbered = placed.withColumn("place", within)
    starts = F.broadcast(starts) if shards * SLOTS <= SMALL else starts  # so many rows at most
    return numbered.join(starts, ["shard", "lot"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
