"""Publishing and fetching: content is chunked, stored as blocks, described by a manifest and announced; and read back through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.operators import blocks
from lodestone.sources import files


def publish(held: DataFrame, new: DataFrame) -> DataFrame:
    """(arrival, cid, size, block_count, title, already_published) of each offered content (arrival, data, title).

    What is published already, or came earlier in the batch, keeps its first size, block count and title. held: (cid, size, block_count, title).
    """
    rows = new.select("arrival", ids.cid_hex(F.col("data")).alias("cid"), F.octet_length("data").cast("long").alias("size"), "title")
    first = Window.partitionBy("cid").orderBy("arrival")
    rows = rows.withColumn("_n", F.row_number().over(first)).withColumn("_title", F.first("title").over(first))
    known = held.select("cid", F.col("size").alias("_size"), F.col("block_count").alias("_blocks"), F.col("title").alias("_held"), F.lit(True).alias("_known"))
    out = rows.join(known, "cid", "left")
    before = F.coalesce("_known", F.lit(False))
    return out.select("arrival", "cid", F.when(before, F.col("_size")).otherwise(F.col("size")).alias("size"), F.when(before, F.col("_blocks")).otherwise(1).cast("long").alias("block_count"), F.when(before, F.col("_held")).otherwise(F.col("_title")).alias("title"), (before | (F.col("_n") > 1)).alias("already_published"))


def outcome(enabled: bool, running: bool, ok: Column) -> Column:
    """not_attempted without a network, skipped where switched off, else success or failed."""
    if not running:
        return F.lit("not_attempted")
    return F.when(ok, "success").otherwise("failed") if enabled else F.lit("skipped")


def manifests(chunks: DataFrame, nodes: DataFrame, metadata: DataFrame, flat: int, fanout: int) -> DataFrame:
    """(doc_id, root_cid, body, children, chunk_count, total_size, structure, depth): each document's manifest and its identifier.

    chunks: (doc_id, idx, size, cid); nodes: the inner nodes of trees; metadata: (doc_id, name, content_type, publisher). A
    tree's children are its topmost nodes, or its chunks where they fit the fanout; a document without chunks is empty and flat.
    """
    shape = blocks.manifest(chunks, flat, fanout)
    leaves = chunks.select("doc_id", F.lit(0).alias("level"), F.col("idx").cast("long").alias("pos"), "cid")
    inner = nodes.select("doc_id", "level", F.col("node").alias("pos"), "cid")
    held = metadata.join(shape, "doc_id", "left")
    top = held.where("chunk_count is not null").select("doc_id", F.when(F.col("structure") == "tree", F.col("depth")).otherwise(0).alias("level"))
    children = leaves.unionByName(inner).join(top, ["doc_id", "level"]).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cid"))), lambda s: s["cid"]).alias("children"))
    out = held.join(children, "doc_id", "left").select(
        "doc_id", "name", "content_type", "publisher", F.coalesce("children", F.array().cast("array<string>")).alias("children"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"),
        F.coalesce("total_size", F.lit(0)).cast("long").alias("total_size"), F.coalesce("structure", F.lit("flat")).alias("structure"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    body = F.to_json(F.struct(*(F.col(c) for c in ("children", "chunk_count", "content_type", "depth", "name", "publisher", "structure", "total_size"))), {"ignoreNullFields": "false"})
    return out.withColumn("body", body).withColumn("root_cid", F.concat(F.lit(ids.DAG_CBOR), F.sha2(F.col("body").cast("binary"), 256)))


def publish_dag(chunks: DataFrame, metadata: DataFrame, flat: int = blocks.FLAT, fanout: int = blocks.FANOUT, running: bool = True, dht: bool = True, gossip: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests with their announcements' outcomes, blocks to store (cid, size), announced (cid, doc_id)) of documents cut into chunks (doc_id, idx, size, cid).

    The root and its children are provided, gossip names the root alone.
    """
    chunks = files.written(chunks.select("doc_id", "idx", "size", "cid"), files.shared(chunks.sparkSession, "publish"), "chunks")  # cut once
    nodes = blocks.build_tree(chunks, fanout, flat=flat)
    made = manifests(chunks, nodes, metadata, flat, fanout)
    made = made.withColumn("dht", outcome(dht, running, F.lit(True))).withColumn("gossip", outcome(gossip, running, F.length("root_cid") > 0))
    stored = chunks.select("cid", F.col("size").cast("long").alias("size")).unionByName(nodes.select("cid", F.octet_length(F.array_join("links", ",")).cast("long").alias("size")))
    stored = stored.unionByName(made.select(F.col("root_cid").alias("cid"), F.octet_length("body").cast("long").alias("size"))).groupBy("cid").agg(F.min("size").alias("size"))
    announced = made.select("doc_id", F.explode(F.array_append("children", F.col("root_cid"))).alias("cid")) if running and dht else made.select("doc_id", F.col("root_cid").alias("cid")).where("false")
    return made, stored, announced.select("cid", "doc_id").distinct()


def info(requests: DataFrame, manifests: DataFrame, stored: DataFrame) -> DataFrame:
    """(cid, status, total_size, chunk_count, is_local): invalid_cid, not_found, or the manifest of each requested root; is_local: its block is held."""
    known = manifests.select(F.col("root_cid").alias("cid"), "total_size", "chunk_count").distinct()
    out = requests.join(known, "cid", "left").join(stored.select("cid", F.lit(True).alias("_l")), "cid", "left")
    status = F.when(~F.col("cid").rlike("^01(55|71)1220[0-9a-f]{64}$"), "invalid_cid").when(F.col("total_size").isNull(), "not_found").otherwise("ok")
    return out.select("cid", status.alias("status"), "total_size", "chunk_count", F.coalesce("_l", F.lit(False)).alias("is_local"))


def read_tree(roots: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, pos, cid, error) of all chunks below each root's children, in depth-first order: pos counts them from 0.

    roots: (doc_id, children); nodes: (level, cid, links) of inner nodes; stored: (cid) of chunks held. error: missing_block for one
    that neither has, mixed_levels for chunks that stand beside inner nodes. Levels are resolved one after another, each by one join.
    """
    inner = nodes.dropDuplicates(["cid"]).select("cid", "links")
    most = nodes.agg(F.max("level")).first()[0] or 0
    front = roots.select("doc_id", F.posexplode("children").alias("at", "cid")).select("doc_id", F.array("at").alias("path"), "cid")
    found = front.where("false")
    for _ in range(most):
        met = front.join(inner, "cid", "left")
        leaves = met.where("links is null").select("doc_id", "path", "cid")
        found = found.unionByName(leaves)
        front = met.where("links is not null").select("doc_id", F.posexplode("links").alias("at", "child"), "path").select("doc_id", F.array_append("path", F.col("at")).alias("path"), F.col("child").alias("cid"))
    found = found.unionByName(front)
    held = found.join(stored.select("cid", F.lit(True).alias("_h")).distinct(), "cid", "left")
    depth = held.groupBy("doc_id").agg((F.min(F.size("path")) != F.max(F.size("path"))).alias("_mixed"))
    order = Window.partitionBy("doc_id").orderBy("path")
    error = F.when(F.col("_h").isNull(), "missing_block").when(F.col("_mixed"), "mixed_levels")
    return held.join(depth, "doc_id").select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "cid", error.alias("error"))


def retried(attempts: DataFrame, most: int) -> DataFrame:
    """(cid, status, tries) of requests from their log (cid, attempt, outcome): ok and not_found end them, other errors are retried `most` times."""
    w = Window.partitionBy("cid").orderBy("attempt")
    rows = attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    last = rows.groupBy("cid").agg(F.min(F.when(F.col("outcome").isin("ok", "not_found"), F.struct("_n", "outcome"))).alias("end"), F.max(F.struct("_n", "outcome")).alias("late"))
    return last.select("cid", F.coalesce("end.outcome", "late.outcome").alias("status"), F.coalesce("end._n", "late._n").cast("long").alias("tries"))
