"""Spaces, index status, published and remote content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import ids, strings


def create_spaces(paths: DataFrame, held: DataFrame) -> DataFrame:
    """(key, name, location) of the paths without a space; a taken name gets 4, then 8 characters of the key."""
    new = paths.select(F.col("location"), ids.space_key(F.col("location")).alias("key")).dropDuplicates(["key"]).join(held.select("key"), "key", "left_anti")
    new = new.withColumn("base", strings.derive_name(F.col("location"), F.col("key")))
    order = Window.partitionBy("base").orderBy("key")
    taken = held.select(F.col("name").alias("base")).distinct().withColumn("taken", F.lit(1))
    named = new.join(taken, "base", "left").withColumn("place", F.row_number().over(order) + F.coalesce("taken", F.lit(0)))
    short = F.concat_ws("-", "base", F.substring("key", 1, 4))
    clash = F.count(F.lit(1)).over(Window.partitionBy("base", F.substring("key", 1, 4)))
    name = F.when(F.col("place") == 1, F.col("base")).when(clash == 1, short).otherwise(F.concat_ws("-", "base", F.substring("key", 1, 8)))
    return named.select("key", name.alias("name"), "location")


def delete_space(space_id: int, spaces: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """The spaces and their child tables without one space."""
    return [spaces.where(F.col("id") != space_id), *(c.where(F.col("space_id") != space_id) for c in children)]


def space_status(spaces: DataFrame, status: DataFrame) -> DataFrame:
    """Every space with its index status, or the default one."""
    out = spaces.join(status, spaces["id"] == status["space_id"], "left")
    defaults = {"files_indexed": 0, "chunks_stored": 0, "files_failed": 0}
    cols = [F.coalesce(F.col(c), F.lit(v).cast("long")).alias(c) for c, v in defaults.items()]
    return out.select(spaces["id"], spaces["name"], F.coalesce(F.col("indexing_in_progress"), F.lit(False)).alias("indexing_in_progress"), *cols)


def space_entities(key: str, spaces: DataFrame, entities: DataFrame) -> DataFrame:
    one = spaces.where(F.col("key") == key).select(F.col("id").alias("space_id"))
    return entities.join(F.broadcast(one), "space_id").orderBy(F.desc("created_at"), "id")


def upsert_status(held: DataFrame, runs: DataFrame) -> DataFrame:
    """Status after (space_id, ok, at, files, failed, error) runs: success stamps and clears the error, failure keeps the last stamp."""
    both = held.join(runs, "space_id", "full_outer")
    ran = F.col("ok").isNotNull()
    return both.select(
        "space_id", F.when(F.col("ok"), F.col("at")).otherwise(F.col("last_indexed")).alias("last_indexed"), F.when(ran, F.lit(False)).otherwise(F.col("indexing_in_progress")).alias("indexing_in_progress"),
        F.when(F.col("ok"), F.col("files")).otherwise(F.col("files_indexed")).alias("files_indexed"), F.when(ran, F.col("failed")).otherwise(F.col("files_failed")).alias("files_failed"),
        F.when(F.col("ok"), F.lit(None).cast("string")).when(ran, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def remote_status(rows: DataFrame, outcome: Column, at: Column) -> DataFrame:
    """The index state of remote content after an outcome: ok, error or reset; null leaves it."""
    return rows.withColumns(
        {
            "indexed": F.when(outcome == "ok", True).when(outcome.isin("error", "reset"), False).otherwise(F.col("indexed")),
            "index_error": F.when(outcome == "error", F.lit("failed")).when(outcome.isin("ok", "reset"), F.lit(None).cast("string")).otherwise(F.col("index_error")),
            "indexed_at": F.when(outcome == "ok", at).when(outcome == "reset", F.lit(None).cast(dict(rows.dtypes)["indexed_at"])).otherwise(F.col("indexed_at")),
        }
    )


def resolve(requests: DataFrame, published: DataFrame, remote: DataFrame) -> DataFrame:
    """(cid, origin, title, size): published content first, then remote, else not_found."""
    p = published.select("cid", F.col("title").alias("p_title"), F.col("size").alias("p_size"))
    r = remote.select("cid", F.col("title").alias("r_title"), F.col("size").alias("r_size"))
    both = requests.join(p, "cid", "left").join(r, "cid", "left")
    origin = F.when(F.col("p_size").isNotNull(), "local").when(F.col("r_size").isNotNull(), "remote").otherwise("not_found")
    return both.select("cid", origin.alias("origin"), F.when(origin == "local", F.col("p_title")).otherwise(F.col("r_title")).alias("title"), F.coalesce("p_size", "r_size").alias("size"))


def providers(published: DataFrame, remote: DataFrame, me: str) -> DataFrame:
    return published.select("cid", F.lit(me).alias("provider")).unionByName(remote.select("cid", F.col("publisher").alias("provider"))).distinct()


def listing(rows: DataFrame, date: str, offset: int, limit: int, most: int = 100) -> DataFrame:
    """A page, newest first; page_count is its size, total the table's."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(F.desc(date), "cid").offset(offset).limit(min(limit, most))
    return part.withColumn("page_count", F.count(F.lit(1)).over(Window.partitionBy())).crossJoin(F.broadcast(total))


def backfill_names(spaces: DataFrame) -> DataFrame:
    """Spaces without a name take the one derived from their location, or their key."""
    return spaces.withColumn("name", F.coalesce("name", strings.derive_name(F.col("location"), F.col("key"))))
