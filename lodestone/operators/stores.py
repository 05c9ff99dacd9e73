"""Keyed stores over logs of changes: messages, routed records, providers, peers, credentials, key-value pairs. Time is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import last_write, numbered, per_key_cap

# Limits of a routed record store.
MOST_PROVIDERS, MOST_RECORDS, MOST_VALUE = 20, 65_536, 65_536


def kv_summary(log: DataFrame, key: str, order: Column, deleted: Column, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((len, is_empty) of a key-value log's view, (key, found) of each probed key)."""
    view = last_write(log, key, order, deleted)
    size = view.agg(F.count(F.lit(1)).alias("len")).withColumn("is_empty", F.col("len") == 0)
    found = probes.join(view.select(key, F.lit(True).alias("_f")), key, "left").select(key, F.coalesce("_f", F.lit(False)).alias("found"))
    return size, found


def store_messages(held: DataFrame, new: DataFrame, enabled: bool = True, tie: str | None = None) -> DataFrame:
    """Messages by id, the last of each stored; where the store is off, nothing is added. tie: a column whose larger value wins between equal times."""
    if not enabled:
        return held
    rows = held.withColumn("_at", F.lit(0)).unionByName(new.select(*held.columns).withColumn("_at", F.lit(1)))
    w = Window.partitionBy("id").orderBy(F.desc("_at"), F.desc("ts_ms"), *([F.desc(tie)] if tie else []))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*held.columns)


def put_records(held: DataFrame, new: DataFrame, order: str, most_value: int = MOST_VALUE, most_records: int = MOST_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(records (key, value, expires), (order, key, outcome) of each put): value_too_large, max_records once the store holds that many, else stored.

    A put of a key that is held replaces its value and needs no room, but is refused at the limit like any other.
    """
    puts = new.withColumn("_large", F.octet_length("value") > most_value)
    known = held.select("key").distinct().withColumn("_h", F.lit(True))
    small = puts.where("not _large").join(known, "key", "left")
    first = F.row_number().over(Window.partitionBy("key").orderBy(order))
    fresh = small.withColumn("_first", first).withColumn("_adds", F.col("_h").isNull() & (F.col("_first") == 1))
    adds = numbered(fresh.where("_adds").select(order), order).select(order, F.col("_place").alias("_added"))
    count = held.select("key").distinct().agg(F.count(F.lit(1)).alias("_count"))
    # The store is full from the put after the one that takes the last room.
    full = adds.crossJoin(F.broadcast(count)).where(F.col("_added") + F.col("_count") >= most_records).agg(F.min(order).alias("_full")).crossJoin(F.broadcast(count))
    out = puts.crossJoin(F.broadcast(full)).withColumn("outcome", F.when(F.col("_large"), "value_too_large").when((F.col("_count") >= most_records) | (F.col(order) > F.col("_full")), "max_records").otherwise("stored"))
    stored = last_write(out.where("outcome = 'stored'").select("key", "value", "expires", order), "key", F.col(order)).drop(order)
    return held.join(stored, "key", "left_anti").unionByName(stored.select(*held.columns)), out.select(order, "key", "outcome")


def live(records: DataFrame, now: Column) -> DataFrame:
    """Records that haven't expired; null never does."""
    return records.where(F.col("expires").isNull() | (F.col("expires") > now))


def add_providers(held: DataFrame, new: DataFrame, order: str, most: int = MOST_PROVIDERS) -> DataFrame:
    """(key, provider, expires, arrival): a provider that is known takes the new expiry, a new one is added while its key has fewer than `most`."""
    rows = held.withColumn("_new", F.lit(0)).unionByName(new.select(*held.columns).withColumn("_new", F.lit(1)))
    w = Window.partitionBy("key", "provider").orderBy(F.desc("_new"), F.desc(order))
    seen = F.min(F.struct("_new", order)).over(Window.partitionBy("key", "provider"))
    one = rows.withColumn("_seen", seen).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return per_key_cap(one, "key", ["_seen", "provider"], most).select(*held.columns)


def peers_at(log: DataFrame, order: str) -> DataFrame:
    """(peer, active, addresses, reconnections, failures, last_success) from a log of saved changes (peer, kind, address, count).

    Kinds: active and inactive, address, reconnections, failures, success (count: its time), forgotten, which drops all before it.
    """
    gone = F.max(F.when(F.col("kind") == "forgotten", F.col(order))).over(Window.partitionBy("peer"))
    rows = log.withColumn("_gone", gone).where((F.col("kind") != "forgotten") & (F.col("_gone").isNull() | (F.col(order) > F.col("_gone"))))
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("count")), F.when(F.col("kind") == kind, F.col(order)))
    state = F.max_by(F.when(F.col("kind").isin("active", "inactive"), F.col("kind") == "active"), F.when(F.col("kind").isin("active", "inactive"), F.col(order)))
    return rows.groupBy("peer").agg(
        F.coalesce(state, F.lit(False)).alias("active"), F.array_sort(F.collect_set(F.when(F.col("kind") == "address", F.col("address")))).alias("addresses"),
        F.coalesce(last("reconnections"), F.lit(0)).alias("reconnections"), F.coalesce(last("failures"), F.lit(0)).alias("failures"), last("success").alias("last_success"),
    )


def should_dial(peers: DataFrame, me: Column, connected: DataFrame, registered: DataFrame, dialing: DataFrame, attempts: DataFrame, now_ms: Column, cooldown_ms: int = 30_000) -> DataFrame:
    """(peer, dial, reason) of discovered peers: not oneself, connected, registered, being dialled, nor tried within the cooldown. attempts: (peer, at)."""
    mark = lambda rows, name: rows.select("peer", F.lit(True).alias(name)).distinct()
    out = peers.join(mark(connected, "_c"), "peer", "left").join(mark(registered, "_r"), "peer", "left").join(mark(dialing, "_d"), "peer", "left")
    out = out.join(attempts.groupBy("peer").agg(F.max("at").alias("_at")), "peer", "left")
    reason = F.when(F.col("peer") == me, "self").when(F.col("_c"), "connected").when(F.col("_r"), "registered").when(F.col("_d"), "dialing").when(now_ms - F.col("_at") < cooldown_ms, "cooldown")
    return out.select("peer", reason.isNull().alias("dial"), reason.alias("reason"))


def provider_outcomes(changes: DataFrame) -> DataFrame:
    """(at, cid, action, outcome, session) of a registry's changes (at, cid, action): add, remove, announce.

    An add of what isn't provided begins a session: added, else present; a remove ends it: removed, else absent; an
    announcement counts in one: announced, else unknown.
    """
    before = Window.partitionBy("cid").orderBy("at", "action").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("action") != "announce", F.col("action")), True).over(before) == "add", F.lit(False))
    outcome = F.when(F.col("action") == "add", F.when(held, "present").otherwise("added")).when(F.col("action") == "remove", F.when(held, "removed").otherwise("absent")).otherwise(F.when(held, "announced").otherwise("unknown"))
    out = changes.withColumn("outcome", outcome)
    session = F.sum((F.col("outcome") == "added").cast("long")).over(Window.partitionBy("cid").orderBy("at", "action").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("at", "cid", "action", "outcome", session.alias("session"))


def provided(changes: DataFrame) -> DataFrame:
    """(cid, first_provided, last_announced, announcement_count) of what a registry holds after all changes: what get_all, contains, count and get_metadata read."""
    rows = provider_outcomes(changes).where(F.col("outcome").isin("added", "removed", "announced"))
    last = rows.groupBy("cid", "session").agg(F.min(F.when(F.col("outcome") == "added", F.col("at"))).alias("first_provided"), F.max(F.when(F.col("outcome") == "announced", F.col("at"))).alias("last_announced"), F.count_if(F.col("outcome") == "announced").alias("announcement_count"), F.count_if(F.col("outcome") == "removed").alias("_gone"))
    return last.where(F.col("_gone") == 0).drop("session", "_gone")


def contains(held: DataFrame, wanted: DataFrame, key: str = "cid") -> DataFrame:
    """(key, held) of each wanted key."""
    return wanted.select(key).join(held.select(key, F.lit(True).alias("held")), key, "left").select(key, F.coalesce("held", F.lit(False)).alias("held"))


def reprovide(provided: DataFrame, now_s: Column, every_s: int = 12 * 3600) -> DataFrame:
    """The provided identifiers whose last announcement is due again."""
    return provided.where(F.col("last_announced").isNull() | (now_s - F.col("last_announced") >= every_s))


def stale(pending: DataFrame, now_s: Column, timeout_s: int = 30) -> tuple[DataFrame, DataFrame]:
    """(pending requests that stay, (id, error) of those past the timeout)."""
    late = now_s - F.col("created_at") > timeout_s
    return pending.where(~late), pending.where(late).select("id", F.format_string("timed out after %ds", (now_s - F.col("created_at")).cast("long")).alias("error"))


def credentials(rows: DataFrame, device: Column | None = None) -> DataFrame:
    """(id, device_id, credential_id, counter) of stored passkeys (id, device_id, json) whose JSON can be read, of one device where given."""
    parsed = F.try_parse_json("json")
    out = rows if device is None else rows.where(F.col("device_id") == device)
    out = out.select("id", "device_id", F.try_variant_get(parsed, "$.cred_id", "string").alias("credential_id"), F.coalesce(F.try_variant_get(parsed, "$.counter", "long"), F.lit(0)).alias("counter"))
    return out.where(F.col("credential_id").isNotNull())


def find_credential(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(credential_id, id): the first row that holds each wanted credential, null if none."""
    first = credentials(rows).groupBy("credential_id").agg(F.min("id").alias("id"))
    return wanted.join(first, "credential_id", "left").select("credential_id", "id")


def count_use(rows: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, device_id, credential_id, counter) after uses (device_id, counter): the first readable credential of the device takes the largest counter."""
    held = credentials(rows)
    first = held.groupBy("device_id").agg(F.min("id").alias("id"))
    new = uses.groupBy("device_id").agg(F.max("counter").alias("_counter")).join(first, "device_id").select("id", "_counter")
    return held.join(new, "id", "left").select("id", "device_id", "credential_id", F.coalesce("_counter", "counter").alias("counter"))
