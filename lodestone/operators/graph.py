"""Entities and edges: listings, lookups, neighbours and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import pseudo_cid


def page(rows: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def entity_list(entities: DataFrame, space_id: int, kind: str | None = None, name_has: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A space's entities, newest first."""
    out = entities.where(F.col("space_id") == space_id)
    if kind is not None:
        out = out.where(F.col("entity_type") == kind)
    if name_has is not None:
        out = out.where(F.contains("name", F.lit(name_has)))
    return page(out, [F.desc("created_at"), "id"], offset, limit)


def find_by_name(entities: DataFrame, space_id: int, name: str, kind: str | None = None) -> DataFrame:
    out = entities.where((F.col("space_id") == space_id) & (F.col("name") == name))
    return page(out if kind is None else out.where(F.col("entity_type") == kind), ["id"], 0, 1)


def get(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def edge_list(edges: DataFrame, kind: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    return page(edges if kind is None else edges.where(F.col("edge_type") == kind), [F.desc("created_at"), "id"], offset, limit)


def find_edge(edges: DataFrame, source: int, target: int, kind: str | None = None) -> DataFrame:
    out = edges.where((F.col("source_id") == source) & (F.col("target_id") == target))
    return out if kind is None else out.where(F.col("edge_type") == kind)


def edges_for(edges: DataFrame, entity: int, direction: str = "both") -> DataFrame:
    """outgoing, incoming, or both one after the other (a self-loop comes twice)."""
    out, into = edges.where(F.col("source_id") == entity), edges.where(F.col("target_id") == entity)
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def counts_by_space(rows: DataFrame) -> DataFrame:
    return rows.groupBy("space_id").agg(F.count(F.lit(1)).alias("n"))


def delete_by_entity(edges: DataFrame, entity: int) -> DataFrame:
    return edges.where((F.col("source_id") != entity) & (F.col("target_id") != entity))


def traverse(edges: DataFrame, start: DataFrame, depth: int, kind: str | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(start, id, depth, path) of the nodes within `depth` (1 or 2) outgoing hops: each once, by its shortest and then least path.

    start: a column "start". The start itself is left out; targets without an entity are followed but not reported.
    """
    if depth not in (1, 2):
        raise ValueError("max depth is 2")
    hops = (edges if kind is None else edges.where(F.col("edge_type") == kind)).select("source_id", "target_id").distinct()
    one = start.distinct().join(hops, F.col("start") == F.col("source_id")).where("target_id <> start").select("start", F.col("target_id").alias("id"), F.array("start", "target_id").alias("path"))
    found = one.withColumn("depth", F.lit(1))
    if depth == 2:
        two = one.join(hops, F.col("id") == F.col("source_id")).where("target_id <> start")
        two = two.select("start", F.col("target_id").alias("id"), F.array_append("path", F.col("target_id")).alias("path"), F.lit(2).alias("depth"))
        found = found.unionByName(two)
    best = found.groupBy("start", "id").agg(F.min(F.struct("depth", "path")).alias("b")).select("start", "id", "b.depth", "b.path")
    return best if entities is None else best.join(entities.select("id"), "id", "left_semi").select("start", "id", "depth", "path")


def with_edges(entity: int, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge_id, edge_type, other_id, other_name, direction) of one entity's edges."""
    out = edges.where(F.col("source_id") == entity).select(F.col("id").alias("edge_id"), "edge_type", F.col("target_id").alias("other_id"), F.lit("outgoing").alias("direction"))
    into = edges.where(F.col("target_id") == entity).select(F.col("id").alias("edge_id"), "edge_type", F.col("source_id").alias("other_id"), F.lit("incoming").alias("direction"))
    return out.unionByName(into).join(entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id")


def per_key_cap(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def insert_if_absent(held: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """The table with the first new row of each key that it lacks."""
    return held.unionByName(per_key_cap(new.join(held.select(key), key, "left_anti"), key, order, 1).select(*held.columns))


def last_write(rows: DataFrame, key: str, order: Column, deleted: Column | None = None) -> DataFrame:
    """Key-value view of a log: each key's last row, deletions dropped."""
    w = Window.partitionBy(key).orderBy(order.desc())
    out = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out if deleted is None else out.where(~deleted)


def create_entities(held: DataFrame, new: DataFrame, now: Column, order: str = "arrival") -> DataFrame:
    """The entities with new ones (arrival, space_id, entity_type, name, properties, created_by) after them: ids follow the largest, each has its pseudo-identifier and no embedding."""
    top = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    body = F.to_json(F.struct("space_id", "entity_type", "name", "properties", "created_by", now.alias("timestamp")))
    rows = numbered(new, order).crossJoin(F.broadcast(top))  # one row
    made = rows.select((F.col("_top") + F.col("_place")).alias("id"), pseudo_cid(body).alias("cid"), "space_id", "entity_type", "name", "properties", F.lit(None).cast("binary").alias("embedding"), now.alias("created_at"), "created_by")
    return held.unionByName(made.select(*held.columns))


def numbered(rows: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """Rows with their place in order of a number, from 1: numbered within ranges and shifted by the ranges before."""
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(order).cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []))
    dealt = rows.withColumn("_part", F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col(order))))
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(order))).join(before, "_part").withColumn("_place", F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def update_embeddings(entities: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the entities with new embeddings of (id, embedding), the ids that no entity has)."""
    new = updates.select("id", F.col("embedding").alias("_e"), F.lit(True).alias("_u"))
    out = entities.join(new, "id", "left").withColumn("embedding", F.when(F.col("_u"), F.col("_e")).otherwise(F.col("embedding"))).select(*entities.columns)
    return out, updates.join(entities.select("id"), "id", "left_anti").select("id")


def delete(rows: DataFrame, unwanted: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows that stay, (rows_affected) of those that go)."""
    gone = F.coalesce(unwanted, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("rows_affected"))


def create_edges(held: DataFrame, new: DataFrame, now: Column, order: str = "arrival") -> DataFrame:
    """The edges with new ones (arrival, space_id, edge_type, source_id, target_id, properties, created_by), numbered after the largest id."""
    top = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    body = F.to_json(F.struct("space_id", "edge_type", "source_id", "target_id", "properties", "created_by", now.alias("timestamp")))
    rows = numbered(new, order).crossJoin(F.broadcast(top))  # one row
    made = rows.select((F.col("_top") + F.col("_place")).alias("id"), pseudo_cid(body).alias("cid"), "space_id", "edge_type", "source_id", "target_id", "properties", now.alias("created_at"), "created_by")
    return held.unionByName(made.select(*held.columns))
