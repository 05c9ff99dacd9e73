"""Structured Streaming forms: subscriptions, routing, dedup, late data, gathered responses, monitors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import folds, network


def topics(stream: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """One filtered stream a topic."""
    return {n: stream.where(F.col("topic") == n) for n in names}


def fresh(stream: DataFrame, ts: str, now: Column, drift_s: int = 300) -> DataFrame:
    """Rows within the allowed drift; older state is dropped by the same bound."""
    return stream.withWatermark(ts, f"{drift_s} seconds").where(F.abs(now - F.unix_seconds(ts)) <= drift_s)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, within: str = "60 seconds") -> DataFrame:
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, width: str, by: str, late: str = "5 minutes") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, by: str, late: str = "5 minutes") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def gather(queries: DataFrame, responses: DataFrame, window: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Stream-stream interval join of responses with their query."""
    q, r = queries.withWatermark("q_ts", late), responses.withWatermark("r_ts", late)
    return q.join(r, F.expr(f"q_id = r_id and r_ts >= q_ts and r_ts <= q_ts + interval {window}"))


def folder(spark: SparkSession) -> str:
    """A folder for streams' files and checkpoints, below the one all executors share (spark.checkpoint.dir); a local session may do without that."""
    sc = spark.sparkContext
    name = sc.getConf().get("spark.checkpoint.dir", None)
    if not name:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        name = tempfile.mkdtemp(prefix="streams-")
    return f"{name.rstrip('/')}/streams"


def run_to_files(stream: DataFrame, finish: Callable[[], None] | None = None) -> DataFrame:
    """A stream run to its end, as a table of Parquet files. Batches are appended; a batch that is run again replaces its own files.

    finish: called once all has come, before the stream goes on with what that adds: such as a row so late that its
    watermark closes the windows that are still open.
    """
    spark = stream.sparkSession
    base = f"{folder(spark)}/{uuid.uuid4().hex}"

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    def run() -> None:
        stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    if finish:
        finish()
        run()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/rows").drop("batch")


def closing(stream: DataFrame, ts: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a place for one more row, and what puts it there: a row of nulls in the year 9999, which ends all windows."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}/last"
    last = spark.range(1).select(*(F.lit("9999-01-01").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields))
    last.where("false").write.parquet(path)
    more = spark.readStream.schema(stream.schema).parquet(path)
    return stream.unionByName(more), lambda: last.write.mode("append").parquet(path)


def subscribe(stream: DataFrame, wanted: Column, handle: Callable[[DataFrame], None], done: str, checkpoint: str, keep: int = 10_000, parts: int | None = None):
    """Runs a handler once for each wanted (event_id, offset). Handled keys are stored, a generation a batch, before the handler runs; the last `keep` of them, and all of the batch, are kept.

    parts: partitions that a batch is dealt into, for sources with batches of known size; else the session's number, which
    may be made for the whole of the data and cost a small batch more in tasks and files than in work.
    """
    kind = "event_id long, offset long"

    def generations(spark: SparkSession) -> list[int]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if "=" in f.getPath().getName()) if fs.exists(path) else []

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        before = generations(spark)
        held = spark.read.schema(kind).parquet(*(f"{done}/generation={g}" for g in before)) if before else spark.createDataFrame([], kind)
        keys, n = ["event_id", "offset"], parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = held.repartition(n, *keys).distinct()
        new = rows.where(wanted).repartition(n, *keys).dropDuplicates(keys).join(held.hint("shuffle_hash"), keys, "left_anti").persist()  # a broadcast would send all kept keys through the driver, batch by batch
        kept = held.orderBy(F.desc("offset")).limit(keep).unionByName(new.select(*keys))
        kept.write.parquet(f"{done}/generation={before[-1] + 1 if before else 0}")
        handle(new)
        new.unpersist()
        for old in before:  # the new one holds what is kept of them
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{done}/generation={old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def route(stream: DataFrame, now_ms: int, most_bytes: int, store: str, stats: str, checkpoint: str):
    """Validates, stores what is delivered, and each batch's counts; a batch that is run again replaces its own files."""

    def batch(rows: DataFrame, number: int) -> None:
        routed = network.routed(rows, now_ms, most_bytes).persist()
        routed.where("outcome = 'delivered'").drop("outcome").write.mode("overwrite").parquet(f"{store}/batch={number}")
        network.router_stats(routed).write.mode("overwrite").parquet(f"{stats}/batch={number}")
        routed.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def rate_limited(stream: DataFrame, key: str, most: int, window_ms: int) -> DataFrame:
    """(key, event_id, allowed) with the anchored window kept as state between batches."""
    out = folds.streamed(stream, key, ["ts_ms", "event_id"], ["ts_ms"], folds.anchored(most, window_ms), "allowed boolean", "anchor long, used long")
    return out.select(key, "event_id", "allowed")


def admitted(stream: DataFrame, key: str, order: str, most: int, reserved: int = 0, policy: str = "strict") -> DataFrame:
    """(key, order, admitted) of (kind, direction) events, each key's open connections kept between batches."""
    return folds.streamed(stream, key, [order], ["kind", "direction"], folds.admitted(most, reserved, policy), "admitted boolean", "active long")


def lifecycles(stream: DataFrame, key: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """(key, order, connections, reconnections, failures) after each event of a peer, its state kept between batches."""
    kept = "connections long, known boolean, reconnections long, failures long"
    return folds.streamed(stream, key, [order], ["kind"], folds.lifecycle, "connections long, reconnections long, failures long", kept, idle_ms)


def failure_monitor(stream: DataFrame, most: float, every: int, stop: Callable[[float], None], checkpoint: str, counts: str):
    """Stops the intake once the failure rate passes one and a half times the limit. Each batch's counts are files, so a restart goes on with them and a repeated batch counts once."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.groupBy("status").count().write.mode("overwrite").parquet(f"{counts}/batch={number}")
        seen = rows.sparkSession.read.schema("status string, count long").parquet(counts)
        n = seen.agg(F.sum(F.when(F.col("status") == "loaded", F.col("count"))), F.sum(F.when(F.col("status") == "failed", F.col("count")))).first()
        loaded, failed = n[0] or 0, n[1] or 0
        if loaded + failed >= every and failed / (loaded + failed) > 1.5 * most:
            stop(failed / (loaded + failed))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
