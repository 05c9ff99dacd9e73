"""Searches over several sources that may fail, caches in front of them, and providers and key-value tables to plug in.

A source's rows are written before they are merged, so an error or a slow source costs its own rows alone. Time is a
parameter, never the clock, but for how long a source may take.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.extensions import ContentProvider, SearchAdapter
from lodestone.functions import ids
from lodestone.operators import search
from lodestone.operators.graph import last_write
from lodestone.sources import files

STATUS = "adapter string, scope string, status string, rows long, error string"


def searched(adapters: Iterable[SearchAdapter], query: DataFrame, limit: int, scope: str = "all", timeout_s: float | None = None, needed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(all rows, (adapter, scope, status, rows, error) of each adapter of a scope).

    Adapters run side by side. status: ok; unhealthy, where the adapter has a `health` that gives an error or a text;
    failed; or timeout, whose jobs are cancelled. Fewer than `needed` that are ok are an error that names the others'.
    """
    if scope not in ("local", "network", "all"):
        raise ValueError(f"invalid scope: {scope}")
    wanted = [a for a in adapters if scope in ("all", a.scope)]
    if not wanted:
        raise ValueError(f"no adapter for {scope}")
    spark = query.sparkSession
    folder, context = files.shared(spark, "searched"), spark.sparkContext

    def run(i: int, adapter: SearchAdapter) -> tuple[str, DataFrame | None, str | None]:
        trouble = getattr(adapter, "health", lambda: None)()
        if trouble:
            return "unhealthy", None, str(trouble)
        context.addJobTag(tags[i])
        return "ok", files.written(adapter.search(query, limit), folder, f"adapter-{i}"), None

    tags = [f"searched-{uuid.uuid4().hex}" for _ in wanted]
    pool = ThreadPoolExecutor(len(wanted), thread_name_prefix="search")
    running: list[Future] = [pool.submit(inheritable_thread_target(spark)(run), i, a) for i, a in enumerate(wanted)]
    wait(running, timeout_s)
    outcomes = []
    for tag, future in zip(tags, running, strict=True):
        if not future.done():
            context.cancelJobsWithTag(tag)
            outcomes.append(("timeout", None, f"over {timeout_s} seconds"))
        elif future.exception():
            outcomes.append(("failed", None, str(future.exception()).split("\n")[0][:500]))
        else:
            outcomes.append(future.result())
    pool.shutdown(wait=False, cancel_futures=True)
    fine = [rows for status, rows, _ in outcomes if status == "ok"]
    if len(fine) < needed:
        raise RuntimeError("; ".join(f"{a.name}: {status}, {error}" for a, (status, _, error) in zip(wanted, outcomes, strict=True) if status != "ok"))
    held = [(a.name, a.scope, status, rows.count() if rows is not None else 0, error) for a, (status, rows, error) in zip(wanted, outcomes, strict=True)]
    return reduce(DataFrame.unionByName, fine), spark.createDataFrame(held, STATUS)


class Table:
    """A source of vectors (vec_id, embedding) as a search adapter."""

    def __init__(self, rows: DataFrame, name: str, scope: str = "local"):
        self.rows, self.name, self.scope = rows, name, scope

    def health(self) -> str | None:
        return None if {"vec_id", "embedding"} <= set(self.rows.columns) else "no vec_id and embedding"

    def search(self, query: DataFrame, limit: int) -> DataFrame:
        near = search.knn(self.rows, query, limit)
        return near.select("query_id", "vec_id", (1.0 - F.col("distance")).alias("score"), F.lit(self.name).alias("source_id"), F.lit(self.scope).alias("source"))


class SearchCache:
    """Answers by query, scope and limit, in Parquet below a path; an answer is good for `ttl_ms` from when it was stored.

    A batch of queries reads the live answers and searches for the others once each; what it finds, nothing included, is
    stored as a generation. At most `capacity` answers stay when `trim` is called, those stored last.
    """

    KEYS = "cache_key string, stored_ms long"

    def __init__(self, spark: SparkSession, path: str, ttl_ms: int = 6 * 3600 * 1000, capacity: int = 10_000):
        self.spark, self.path, self.ttl_ms, self.capacity, self.turn = spark, path.rstrip("/"), ttl_ms, capacity, threading.Lock()

    def _live(self, now_ms: int) -> DataFrame:
        """(cache_key, stored_ms): each live answer's last storing."""
        if not files.names(self.spark, f"{self.path}/keys"):
            return self.spark.createDataFrame([], self.KEYS)
        held = self.spark.read.schema(self.KEYS).option("recursiveFileLookup", "true").parquet(f"{self.path}/keys")
        return held.where((F.col("stored_ms") <= now_ms) & (now_ms - F.col("stored_ms") < self.ttl_ms)).groupBy("cache_key").agg(F.max("stored_ms").alias("stored_ms"))

    def through(self, adapter: SearchAdapter, queries: DataFrame, limit: int, now_ms: int) -> tuple[DataFrame, DataFrame]:
        """((query_id, *the adapter's columns), (query_id, cache_key, hit)) of queries (query_id, query, scope, embedding)."""
        with self.turn:
            folder = files.shared(self.spark, "cache")
            keyed = queries.withColumn("cache_key", ids.cache_key(F.col("query"), F.col("scope"), limit))
            asked = files.written(keyed.join(self._live(now_ms), "cache_key", "left").withColumn("hit", F.col("stored_ms").isNotNull()), folder, "asked")
            missing = asked.where(~F.col("hit")).groupBy("cache_key").agg(F.min_by("query_id", "query_id").alias("query_id"), F.min_by("embedding", "query_id").alias("embedding"))
            missing = files.written(missing, folder, "missing")
            if missing.limit(1).count():
                found = adapter.search(missing.select("query_id", "embedding"), limit).join(missing.select("query_id", "cache_key"), "query_id").drop("query_id").withColumn("stored_ms", F.lit(now_ms).cast("long"))
                name = uuid.uuid4().hex
                found.write.parquet(f"{self.path}/answers/{name}")
                missing.select("cache_key", F.lit(now_ms).cast("long").alias("stored_ms")).write.parquet(f"{self.path}/keys/{name}")  # last: answers without a key aren't read
            answers = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/answers")
            current = asked.withColumn("stored_ms", F.coalesce("stored_ms", F.lit(now_ms).cast("long"))).select("query_id", "cache_key", "stored_ms")
            return current.join(answers, ["cache_key", "stored_ms"]).drop("cache_key", "stored_ms"), asked.select("query_id", "cache_key", "hit")

    def trim(self, now_ms: int) -> int:
        """Drops what is out of date and all but the last `capacity` answers; returns how many stay."""
        with self.turn:
            kept = self._live(now_ms).orderBy(F.desc("stored_ms"), "cache_key").limit(self.capacity)
            folder = files.shared(self.spark, "trim")
            kept = files.written(kept, folder, "keys")
            n = kept.count()
            with contextlib.suppress(FileNotFoundError):
                if files.names(self.spark, f"{self.path}/answers"):
                    rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/answers").join(kept, ["cache_key", "stored_ms"])
                    files.written(rows, folder, "answers")
                    for part in ("answers", "keys"):
                        files.delete(self.spark, f"{self.path}/{part}")
                        files.rename(self.spark, f"{folder}/{part}", f"{self.path}/{part}/{uuid.uuid4().hex}")
            return n


class Holders:
    """A table (cid, provider) of who holds which block, as a content provider; offers come in order of the provider's name from a rank on."""

    def __init__(self, held: DataFrame, rank: int = 0):
        self.held, self.rank = held, rank

    def offers(self, wanted: DataFrame) -> DataFrame:
        met = wanted.select("cid").distinct().join(self.held.select("cid", "provider").distinct(), "cid")
        place = F.row_number().over(Window.partitionBy("cid").orderBy("provider"))
        return met.select("cid", "provider", (place + F.lit(self.rank)).alias("rank"), F.lit(True).alias("has"))


def offered(providers: Iterable[ContentProvider], wanted: DataFrame) -> DataFrame:
    """The offers (cid, provider, rank, has) of all providers."""
    return reduce(DataFrame.unionByName, [p.offers(wanted) for p in providers])


class ParquetKv:
    """A key-value table over a log of changes (key, value, at, deleted) in Parquet: the last change of a key counts."""

    SCHEMA = "key string, value binary, at long, deleted boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        if not files.names(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def view(self) -> DataFrame:
        return last_write(self._log(), "key", F.col("at"), F.col("deleted")).select("key", "value")

    def apply(self, changes: DataFrame) -> None:
        """Adds changes (key, value, at, deleted), all or none."""
        staged = f"{self.path}/_{uuid.uuid4().hex}"
        changes.select("key", F.col("value").cast("binary").alias("value"), F.col("at").cast("long").alias("at"), "deleted").write.parquet(staged)
        files.rename(self.spark, staged, f"{self.path}/changes-{uuid.uuid4().hex}")
