"""Messages, announcements, peers, providers, rate limits and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.folds import admitted, anchored, challenged, folded, lifecycle


def expired(ts_ms: Column, ttl_s: Column, now_ms: Column) -> Column:
    """Past its time to live; 0 never expires."""
    return (ttl_s > 0) & (now_ms > ts_ms + ttl_s * 1000)


def history(messages: DataFrame, topic: str, now_ms: int, since_ms: int | None = None, limit: int = 100) -> DataFrame:
    out = messages.where((F.col("topic") == topic) & ~expired(F.col("ts_ms"), F.col("ttl"), F.lit(now_ms)))
    out = out if since_ms is None else out.where(F.col("ts_ms") >= since_ms)
    return out.orderBy("ts_ms", "id").limit(limit)


def cleanup(messages: DataFrame, now_ms: int, age_ms: int = 300_000) -> DataFrame:
    return messages.where(F.col("ts_ms") + age_ms >= now_ms)


def routed(messages: DataFrame, now_ms: int, most_bytes: int, body: str = "props") -> DataFrame:
    """Each message's outcome: dropped_invalid, dropped_expired or delivered."""
    invalid = (F.col("version") != 1) | (F.octet_length(body) > most_bytes)
    return messages.withColumn("outcome", F.when(invalid, "dropped_invalid").when(expired(F.col("ts_ms"), F.col("ttl"), F.lit(now_ms)), "dropped_expired").otherwise("delivered"))


def router_stats(routed_rows: DataFrame, by: str = "topic") -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return routed_rows.groupBy(by).agg(F.count(F.lit(1)).alias("received"), count("delivered").alias("delivered"), count("dropped_expired").alias("dropped_expired"), count("dropped_invalid").alias("dropped_invalid"))


def announcement_error(now_s: Column, most_size: int = 1 << 30, drift_s: int = 300, check_peer: bool = True) -> Column:
    """The first failed check of (version, cid, publisher_peer_id, sender, size, timestamp, publisher_did, title); null if valid."""
    checks = [
        (F.col("version") != 1, "unsupported_version"), (F.col("cid") == "", "empty_cid"), (~F.col("cid").startswith("bafy") & ~F.col("cid").startswith("Qm"), "invalid_cid"),
        (F.lit(check_peer) & (F.col("publisher_peer_id") != F.col("sender")), "peer_mismatch"), ((F.col("size") <= 0) | (F.col("size") > most_size), "invalid_size"),
        (F.abs(now_s - F.col("timestamp")) > drift_s, "timestamp_drift"), (F.col("publisher_peer_id") == "", "empty_publisher_peer_id"), (F.col("publisher_did") == "", "empty_publisher_did"), (F.col("title") == "", "empty_title"),
    ]
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in checks))


def discover(announcements: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """The first announcement of each cid that isn't known."""
    w = Window.partitionBy("cid").orderBy(*order)
    return announcements.join(known.select("cid"), "cid", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rate_limited(rows: DataFrame, key: str, ts_ms: str, order: str, most: int, window_ms: int) -> DataFrame:
    """(key, order, allowed): at most `most` rows in a window anchored at its first row; a row `window_ms` or more after the anchor opens the next."""
    return folded(rows, key, [ts_ms, order], [ts_ms], anchored(most, window_ms), "allowed boolean").select(key, order, "allowed")


def admit(rows: DataFrame, key: str, order: str, most: int, reserved: int = 0, policy: str = "strict") -> DataFrame:
    """(key, order, admitted) of (direction, kind) events in order: a connection is refused at the limit, and a close frees a place."""
    return folded(rows, key, [order], ["kind", "direction"], admitted(most, reserved, policy), "admitted boolean")


def lifecycles(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, connections, reconnections, failures) after each event (kind) of a peer."""
    return folded(rows, key, [order], ["kind"], lifecycle, "connections long, reconnections long, failures long")


def challenges(rows: DataFrame, key: str, order: str, ttl_ms: int = 300_000) -> DataFrame:
    """(key, order, outcome) of (kind issue or finish, ts_ms) events: issued, accepted, expired or missing."""
    return folded(rows, key, [order], ["kind", "ts_ms"], challenged(ttl_ms), "outcome string")


def may_accept(current: Column, inbound: Column, most: int, reserved: int = 0, policy: str = "strict") -> Column:
    limit = F.when(inbound & F.lit(policy == "prefer_outbound"), F.lit(max(0, most - reserved))).otherwise(F.lit(most))
    return F.lit(most == 0) | (current < limit)


def peer_fold(events: DataFrame) -> DataFrame:
    """One row a peer from (peer, kind, ts, address) events."""
    return events.groupBy("peer").agg(
        F.count_if(F.col("kind") == "established").alias("connection_count"), F.greatest(F.count_if(F.col("kind") == "established") - 1, F.lit(0)).alias("reconnections"),
        F.count_distinct("address").alias("addresses"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def failures_since_success(events: DataFrame) -> DataFrame:
    """(peer, failures): failed events after the last established one."""
    last = F.max(F.when(F.col("kind") == "established", F.col("ts"))).over(Window.partitionBy("peer"))
    return events.withColumn("_last", last).groupBy("peer").agg(F.count_if((F.col("kind") == "failed") & (F.col("_last").isNull() | (F.col("ts") > F.col("_last")))).alias("failures"))


def purge(peers: DataFrame, now: Column, failures: int = 5, ttl_s: int = 7 * 86400) -> DataFrame:
    """The peers that stay: too many failures go; of the unconnected, so do those without a success within the time."""
    age = now - F.col("last_success")
    stale = ~F.col("connected") & (F.col("last_success").isNull() | (age > ttl_s))
    return peers.where((F.col("failures") < failures) & ~stale)


def network_stats(peers: DataFrame) -> DataFrame:
    return peers.agg(F.count_if("connected").alias("connected_peers"), F.count(F.lit(1)).alias("known_peers"), F.sum("connection_count").cast("long").alias("total_connections"), F.sum("reconnections").cast("long").alias("total_reconnections"))


def merge_peers(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger count and all addresses of (peer, reconnections, addresses) rows."""
    return a.unionByName(b).groupBy("peer").agg(F.max("reconnections").alias("reconnections"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("addresses")))).alias("addresses"))


def provider_metadata(announcements: DataFrame) -> DataFrame:
    return announcements.groupBy("cid").agg(F.min("ts").alias("first_provided"), F.max("ts").alias("last_announced"), F.count(F.lit(1)).alias("announcement_count"))


def outcomes(rows: DataFrame, by: str) -> DataFrame:
    """Counts over (channel, ok) announcement outcomes."""
    return rows.groupBy(by).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.bool_or("ok").alias("any_ok"), F.every("ok").alias("all_ok"))


def retry_due(attempts: Column, elapsed_ms: Column, most: int, base_ms: int = 1000) -> Column:
    """Exponential backoff: base times two to the attempts (ten at most) has passed."""
    return (attempts < most) & (elapsed_ms >= base_ms * F.pow(F.lit(2), F.least(attempts, F.lit(10))))


def gather(queries: DataFrame, responses: DataFrame, window_ms: int = 500, per_query: int | None = None, key: str = "topic") -> DataFrame:
    """Responses that came within the window of their query (query_id, key, q_ts), at most `per_query` of each, in order of arrival (response_id, key, r_ts).

    Both sides meet by key and window-long span of time, each response in its own span and the one before, so a busy key's
    rows are dealt out and only near ones are paired.
    """
    span = lambda c: F.expr(f"{c} div {max(1, window_ms)}")
    q = queries.withColumn("_span", span("q_ts"))
    r = responses.withColumn("_span", F.explode(F.array(span("r_ts"), span("r_ts") - 1)))
    met = q.join(r, [key, "_span"]).where((F.col("r_ts") >= F.col("q_ts")) & (F.col("r_ts") <= F.col("q_ts") + window_ms)).drop("_span")
    w = Window.partitionBy("query_id").orderBy("r_ts", "response_id")
    out = met.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if per_query is None else out.where(F.col("rank") <= per_query)


def accumulated(queries: DataFrame, batches: DataFrame, now: Column, timeout: int, key: str = "query_id") -> DataFrame:
    """(key, providers, status) of pending queries (key, asked_at): the distinct providers of all batches (key, provider, at) within the timeout.

    found with any; else pending before the timeout and timeout after it.
    """
    met = queries.join(batches, key, "left").groupBy(key, "asked_at").agg(F.size(F.collect_set(F.when(F.col("at") - F.col("asked_at") <= timeout, F.col("provider")))).cast("long").alias("providers"))
    return met.select(key, "providers", F.when(F.col("providers") > 0, "found").when(now - F.col("asked_at") > timeout, "timeout").otherwise("pending").alias("status"))


def throughput(rows: DataFrame, by: str) -> DataFrame:
    """(by, messages, per_second) of (ts_ms) rows over the time from the first to the last."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("messages"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("_s"))
    return out.select(by, "messages", F.when(F.col("_s") > 0, F.col("messages") / F.col("_s")).otherwise(0.0).alias("per_second"))


def message_error(most_bytes: int, now_ms: Column | None = None) -> Column:
    """The first failed check of a message (version, id, source, topic, ts_ms, ttl, format, payload): version, size of its serialised form, or expiry; null if valid."""
    whole = F.to_json(F.struct("format", "id", "payload", "source", F.col("ts_ms").alias("timestamp"), "topic", "ttl", "version"))
    out = F.when(F.col("version") != 1, "invalid_version").when(F.octet_length(whole) > most_bytes, "too_large")
    return out if now_ms is None else out.when(expired(F.col("ts_ms"), F.col("ttl"), now_ms), "expired")


def latency(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg("latency_ms").alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.count(F.lit(1)).alias("messages"))
