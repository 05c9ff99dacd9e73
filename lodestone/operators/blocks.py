"""Content-addressed blocks, manifests, trees of manifests, and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import files

FLAT, FANOUT = 40_000, 174


def put(store: DataFrame, new: DataFrame, most_bytes: int, capacity: int | None = None, order: str = "arrival", parts: int = 64) -> DataFrame:
    """(order, cid, size, outcome) of each offered block: stored, duplicate, too_large or full. Blocks are counted in order up to the capacity.

    order: a number. Running sizes are summed within ranges of it and shifted by the ranges before, so no task sees all blocks.
    """
    first = Window.partitionBy("cid").orderBy(order)
    rows = new.withColumn("_n", F.row_number().over(first)).join(store.select("cid", F.lit(True).alias("_held")), "cid", "left")
    outcome = F.when(F.col("size") > most_bytes, "too_large").when(F.col("_held") | (F.col("_n") > 1), "duplicate").otherwise("stored")
    rows = rows.withColumn("outcome", outcome)
    if capacity is not None:
        cuts = sorted(set(new.agg(F.percentile_approx(F.col(order).cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []))
        fresh = rows.where("outcome = 'stored'").withColumn("_part", F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col(order))))
        before = fresh.groupBy("_part").agg(F.sum("size").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        within = F.sum("size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        over = fresh.withColumn("_within", within).join(before, "_part").where(F.col("_before") + F.col("_within") > capacity).select(order, F.lit("full").alias("_full"))
        rows = rows.join(over, order, "left").withColumn("outcome", F.coalesce("_full", "outcome"))
    return rows.select(order, "cid", "size", "outcome")


def stats(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count(F.lit(1)).alias("block_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size_bytes"))


def get_batch(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pos, cid, found, size) of the requested cids, order kept, misses null."""
    return requests.join(blocks.select("cid", "size", F.lit(True).alias("_f")), "cid", "left").select("pos", "cid", F.coalesce("_f", F.lit(False)).alias("found"), "size")


def delete_unpinned(blocks: DataFrame, targets: DataFrame, pins: DataFrame) -> DataFrame:
    """The blocks that stay: all but targets without a pin."""
    return blocks.join(targets.join(pins, "cid", "left_anti").select("cid"), "cid", "left_anti")


def pinned(blocks: DataFrame, pins: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cid) pinned after the changes, (at, cid, action, outcome) of each): changes (at, cid, action pin or unpin) in order of `at`.

    A pin of a block that isn't held is not_found; an unpin of one that isn't pinned is not_pinned.
    """
    w = Window.partitionBy("cid").orderBy("at")
    held = changes.join(blocks.select("cid", F.lit(True).alias("_b")).distinct(), "cid", "left").join(pins.select("cid", F.lit(True).alias("_p")).distinct(), "cid", "left")
    real = (F.col("action") == "unpin") | F.col("_b").isNotNull()
    before = F.last(F.when(real, F.col("action") == "pin"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    was = F.coalesce(before, "_p", F.lit(False))
    outcome = F.when(~real, "not_found").when((F.col("action") == "unpin") & ~was, "not_pinned").otherwise("ok")
    done = held.withColumn("outcome", outcome)
    last = done.where("outcome = 'ok'").groupBy("cid").agg(F.max(F.struct("at", "action")).alias("l")).select("cid", (F.col("l.action") == "pin").alias("on"))
    after = pins.select("cid").distinct().join(last.where("not on"), "cid", "left_anti").unionByName(last.where("on").select("cid")).distinct()
    return after, done.select("at", "cid", "action", "outcome")


def _levels(chunks: DataFrame, fanout: int) -> int:
    """Levels of inner nodes that the longest document needs."""
    most = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = 0
    while most > fanout:
        most, levels = -(-most // fanout), levels + 1
    return levels


def tree_levels(chunks: DataFrame, flat: int = FLAT, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, level, node, children): how many children each inner node has. Level 1 packs chunks, each further level the one below, until one fits the fanout."""
    total = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > flat)
    level = total.select("doc_id", F.col("n").alias("width"))
    out = level.where("false").select("doc_id", F.lit(0).alias("level"), F.col("width").alias("node"), F.col("width").alias("children"))
    for k in range(1, _levels(chunks, fanout) + 1):
        level = level.where(F.col("width") > fanout)
        nodes = level.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(width - 1) div {fanout}"))).alias("node"), "width")
        out = out.unionByName(nodes.select("doc_id", F.lit(k).alias("level"), "node", F.least(F.lit(fanout).cast("long"), F.col("width") - F.col("node") * fanout).alias("children")))
        level = level.withColumn("width", F.expr(f"(width + {fanout - 1}) div {fanout}"))
    return out


def manifest(chunks: DataFrame, flat: int = FLAT, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, chunk_count, total_size, structure, depth, root_children). A count above `flat` that fits the fanout is a tree of depth 0."""
    held = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("size").cast("long").alias("total_size")).withColumns({"_width": F.col("chunk_count"), "_depth": F.lit(0)})
    for _ in range(_levels(chunks, fanout)):
        more = F.col("_width") > fanout
        held = held.withColumns({"_depth": F.col("_depth") + more.cast("int"), "_width": F.when(more, F.expr(f"(_width + {fanout - 1}) div {fanout}")).otherwise(F.col("_width"))})
    tree = F.col("chunk_count") > flat
    return held.select("doc_id", "chunk_count", "total_size", F.when(tree, "tree").otherwise("flat").alias("structure"), F.when(tree, F.col("_depth")).otherwise(0).cast("int").alias("depth"), F.when(tree, F.col("_width")).otherwise(F.col("chunk_count")).cast("long").alias("root_children"))


def build_tree(chunks: DataFrame, fanout: int = FANOUT, flat: int = 0) -> DataFrame:
    """(doc_id, level, node, cid, links): the inner nodes themselves, of documents of over `flat` chunks. A node's cid is the digest of its ordered children's.

    A level's nodes carry how many there are, so the next one's number is arithmetic; each level is written before the
    one above reads it.
    """
    folder = files.shared(chunks.sparkSession, "tree")
    wide = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("width")).where((F.col("width") > flat) & (F.col("width") > fanout))
    below = files.written(chunks.select("doc_id", F.col("idx").cast("long").alias("pos"), "cid").join(wide, "doc_id"), folder, "level-0")
    out = below.where("false").select("doc_id", F.lit(0).alias("level"), F.col("pos").alias("node"), "cid", F.array("cid").alias("links"))
    most, level = below.agg(F.max("width")).first()[0] or 0, 0
    while most > fanout:
        most, level = -(-most // fanout), level + 1
        part = below.where(F.col("width") > fanout).groupBy("doc_id", F.expr(f"pos div {fanout}").alias("node"), F.expr(f"(width + {fanout - 1}) div {fanout}").alias("width"))
        part = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cid"))), lambda s: s["cid"]).alias("links"))
        part = part.withColumn("cid", F.concat(F.lit("01711220"), F.sha2(F.array_join("links", ",").cast("binary"), 256))).withColumn("level", F.lit(level))
        part = files.written(part, folder, f"level-{level}")
        out = out.unionByName(part.select(*out.columns))
        below = part.select("doc_id", F.col("node").alias("pos"), "cid", "width")
    return out


def expand(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, cid) of the chunks below a document's level 1 nodes, in order."""
    rows = nodes.where("level = 1").select("doc_id", "node", F.posexplode("links").alias("at", "cid"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("node", "at")).cast("long").alias("pos"), "cid")


def offsets(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def contains_offset(start: Column, size: Column, offset: Column) -> Column:
    """Does [start, start + size) hold an offset?"""
    return (offset >= start) & (offset < start + size)


def read_range(chunks: DataFrame, start: int, end: int, part: str = "chunk") -> DataFrame:
    """(doc_id, text, error): [start, end) of each document, end clamped to its size; a start beyond it is an error. Characters of text chunks, bytes of binary ones."""
    placed = offsets(chunks)
    sizes = placed.groupBy("doc_id").agg(F.sum("size").cast("long").alias("total"))
    stop = F.least(F.lit(end).cast("long"), F.col("total"))
    hit = placed.join(sizes, "doc_id").where((F.col("start") < stop) & (F.col("start") + F.col("size") > start))
    low = F.greatest(F.lit(start).cast("long") - F.col("start"), F.lit(0)).cast("int")
    piece = F.substring(part, low + 1, (F.least(F.col("size"), stop - F.col("start")) - low).cast("int"))
    text = hit.select("doc_id", "idx", piece.alias("part")).groupBy("doc_id").agg(joined("part").alias("text"))
    return sizes.join(text, "doc_id", "left").select("doc_id", "text", F.when(F.col("total") <= start, "out_of_bounds").alias("error"))


def joined(part: str) -> Column:
    """An aggregate: the parts of a group in order of idx, as one string or binary value."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", part))), lambda s: s[part])
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), lambda a, b: F.concat(a, b))


def read_all(chunks: DataFrame) -> DataFrame:
    """(doc_id, text) of all chunks in order."""
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk"))), lambda s: s["chunk"]), "").alias("text"))


def waterfall(requests: DataFrame, local: DataFrame, offers: DataFrame, tries: int = 3) -> DataFrame:
    """(cid, origin, attempts): local first, else the first of at most `tries` providers, in rank order, that has the block.

    offers: (cid, provider, rank, has).
    """
    ranked = offers.withColumn("_n", F.row_number().over(Window.partitionBy("cid").orderBy("rank", "provider"))).where(F.col("_n") <= tries)
    found = ranked.groupBy("cid").agg(F.min(F.when(F.col("has"), F.struct("_n", "provider"))).alias("f"), F.max("_n").alias("tried"))
    out = requests.join(local.select("cid", F.lit(True).alias("_l")), "cid", "left").join(found, "cid", "left")
    origin = F.when(F.col("_l"), "local").when(F.col("f").isNotNull(), F.col("f.provider")).otherwise("not_found")
    return out.select("cid", origin.alias("origin"), F.when(F.col("_l"), 0).otherwise(F.coalesce("f._n", "tried", F.lit(0))).cast("long").alias("attempts"))


def answer(requests: DataFrame, blocks: DataFrame, manifests: DataFrame) -> DataFrame:
    """A content server's status of each (cid, kind) request: block, manifest, not_found or error."""
    out = requests.join(blocks.select("cid", F.lit(1).alias("_b")), "cid", "left").join(manifests.select("cid", F.lit(1).alias("_m")), "cid", "left")
    status = F.when((F.col("kind") == "block") & F.col("_b").isNotNull(), "block").when((F.col("kind") == "manifest") & F.col("_m").isNotNull(), "manifest").when(F.col("kind").isin("block", "manifest"), "not_found")
    return out.select("cid", "kind", F.coalesce(status, F.lit("error")).alias("status"))


def verified(blocks: DataFrame, cid: Column, data: Column) -> DataFrame:
    """The blocks whose bytes have their identifier's digest."""
    return blocks.where(F.substring(cid, 9, 64) == F.sha2(data, 256))
