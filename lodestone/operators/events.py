"""The event log: offsets, causality, hash chains, reads, subscriptions; and version vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.folds import folded

GENESIS = "0" * 64


def spans(rows: DataFrame, ts: str, tie: str, parts: int) -> tuple[list[int], int | None, int | None]:
    """(at most `parts` - 1 times, in microseconds, that deal rows into about equal spans; the least and greatest tie, if ties are numbers)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    found = F.percentile_approx(at, [i / parts for i in range(1, parts)], 20 * parts)
    if dict(rows.dtypes)[tie] in ("bigint", "int"):
        times, low, high = rows.agg(found, F.min(tie), F.max(tie)).first()
    else:
        (times,), low, high = rows.agg(found).first(), None, None
    return sorted(set(times or [])), low, high


def below(value: Column, edges: list[int], first: int = 0) -> Column:
    """How many of some sorted numbers are below a value, by halves."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    return F.when(value > edges[middle], below(value, edges[middle + 1 :], first + middle + 1)).otherwise(below(value, edges[:middle], first))


def append_offsets(events: DataFrame, head: int = -1, ts: str = "ts", tie: str = "event_id", stream: str | None = None, parts: int = 64) -> DataFrame:
    """Offsets that follow the head, in order of time and tie, by stream or over the whole log.

    Rows are numbered within spans of time that hold about 1 / `parts` of them, and the spans' counts, a row a span,
    shift them, so no task sees a whole log or stream. A time that many rows share is a span of its own, cut again by
    ranges of the tie. The numbers depend on the rows alone.
    """
    times, low, high = spans(events, ts, tie, parts)
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**63)))
    within = at.isin(times) if times else F.lit(False)
    fine = F.lit(0).cast("long") if low is None else F.floor((F.col(tie) - low) * parts / (high - low + 1)).cast("long")
    key = [stream] if stream is not None else []
    dealt = events.withColumn("_span", 2 * below(at, times) + within.cast("int")).withColumn("_fine", F.when(within, fine).otherwise(F.lit(0).cast("long")))
    sizes = dealt.groupBy(*key, "_span", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_span", "_fine").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, "_span", "_fine", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*key, "_span", "_fine").orderBy(ts, tie))
    placed = dealt.withColumn("_place", place).join(starts, [*key, "_span", "_fine"])
    return placed.withColumn("offset", F.col("_start") + F.col("_place") + F.lit(head).cast("long")).select(*events.columns, "offset")


def between(log: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Offsets from start on, before end."""
    out = log.where(F.col("offset") >= start)
    return (out if end is None else out.where(F.col("offset") < end)).orderBy("offset")


def head(log: DataFrame) -> DataFrame:
    return log.agg(F.max("offset").alias("head_offset"), F.count(F.lit(1)).alias("event_count"))


def running_causality(log: DataFrame, stream: str, actor: str) -> DataFrame:
    """Each event's clock: how many events its actor has had in the stream."""
    w = Window.partitionBy(stream, actor).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("clock", F.count(F.lit(1)).over(w))


def precedes(a: Column, b: Column) -> Column:
    """Every actor of a is in b with no smaller clock."""
    return F.forall(F.map_entries(a), lambda e: F.coalesce(F.element_at(b, e["key"]) >= e["value"], F.lit(False)))


def concurrent(a: Column, b: Column) -> Column:
    return ~precedes(a, b) & ~precedes(b, a)


def merged(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def incremented(a: Column, actor: Column) -> Column:
    """struct<clocks, dots>: the actor's clock one higher, and that dot alone."""
    clock = F.coalesce(F.element_at(a, actor), F.lit(0)) + 1
    return F.struct(F.map_concat(F.map_filter(a, lambda k, _: k != actor), F.create_map(actor, clock)).alias("clocks"), F.array(F.struct(actor.alias("actor"), clock.alias("n"))).alias("dots"))


def merge_clocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, actor, clock): the largest clock of each actor over rows with a map column "clocks"."""
    return rows.select(key, F.explode("clocks").alias("actor", "clock")).groupBy(key, "actor").agg(F.max("clock").alias("clock"))


def canonical(event_id: Column, kind: Column, version: Column, payload: Column, ts_ms: Column, signer: Column, clock: Column) -> tuple[Column, Column]:
    """The hashed form in two parts, before and after the previous hash: keys in alphabetical order, without the signature. payload: JSON text."""
    text = lambda c: F.to_json(F.array(c.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2)  # noqa: E731  a quoted string
    head = F.concat(
        F.lit('{"causality":{"clocks":{'), text(signer), F.lit(":"), clock.cast("string"), F.lit('},"dots":[['), text(signer), F.lit(","), clock.cast("string"), F.lit(']]},"id":'), text(event_id),
        F.lit(',"payload":'), payload, F.lit(',"prev_hash":"'),
    )
    tail = F.concat(F.lit('","redactable":false,"schema_version":'), version.cast("string"), F.lit(',"signer":'), text(signer), F.lit(',"trust_refs":[],"ts":'), ts_ms.cast("string"), F.lit(',"type":'), text(kind), F.lit("}"))
    return head, tail


def chain(log: DataFrame, stream: str, genesis: str = GENESIS) -> DataFrame:
    """(stream, offset, prev_hash, hash): each event's hash covers its head, the hash before it and its tail, stream by stream in order."""

    def step(state, row):
        before = state[0] if state else genesis
        after = hashlib.sha256(f"{row[0]}{before}{row[1]}".encode()).hexdigest()
        return (after,), (before, after)

    return folded(log, stream, ["offset"], ["head", "tail"], step, "prev_hash string, hash string")


def rejected(rows: DataFrame, registry: Schemas) -> Column:
    """Why an event can't be appended: schema_not_found, the first field that breaks its schema, or invalid_payload without a signature or its type."""
    unsigned = (F.coalesce(F.length("sig"), F.lit(0)) == 0) | (F.coalesce(F.length("sig_type"), F.lit(0)) == 0)
    return F.coalesce(registry.error(F.col("type"), F.col("schema_version"), F.col("payload")), F.when(unsigned, "invalid_payload"))


def append(events: DataFrame, registry: Schemas, heads: DataFrame | None = None, stream: str = "stream") -> tuple[DataFrame, DataFrame]:
    """(appended, refused) of new events (event_id, stream, type, schema_version, payload, ts, signer, sig, sig_type).

    Appended ones get the stream's next offsets in order of time and id, their signer's clock, the hash before them and
    their own. heads: (stream, head_offset, prev_hash, clocks) of what each stream holds so far.
    """
    checked = events.withColumn("error", rejected(events, registry))
    fresh = append_offsets(checked.where("error is null").drop("error"), stream=stream)
    clock = F.row_number().over(Window.partitionBy(stream, "signer").orderBy("offset")).cast("long")
    fresh = fresh.withColumn("clock", clock)
    genesis = F.lit(GENESIS)
    if heads is not None:
        fresh = fresh.join(heads, stream, "left").withColumn("offset", F.col("offset") + F.coalesce("head_offset", F.lit(-1)) + 1)
        fresh = fresh.withColumn("clock", F.col("clock") + F.coalesce(F.try_element_at("clocks", F.col("signer")), F.lit(0)))
        genesis = F.coalesce("prev_hash", genesis)
    head, tail = canonical(F.col("event_id"), F.col("type"), F.col("schema_version"), F.col("payload"), F.unix_millis(F.col("ts").cast("timestamp")), F.col("signer"), F.col("clock"))
    bodies = fresh.select(stream, "offset", head.alias("head"), tail.alias("tail"), genesis.alias("start"))

    def step(state, row):
        before = state[0] if state else row[2]
        after = hashlib.sha256(f"{row[0]}{before}{row[1]}".encode()).hexdigest()
        return (after,), (before, after)

    hashes = folded(bodies, stream, ["offset"], ["head", "tail", "start"], step, "prev_hash string, hash string")
    return fresh.select(*events.columns, "offset", "clock").join(hashes, [stream, "offset"]), checked.where("error is not null")


def heads(log: DataFrame, stream: str = "stream") -> DataFrame:
    """(stream, head_offset, prev_hash, clocks, event_count): where the next event of each stream goes on."""
    last = log.groupBy(stream).agg(F.max(F.struct("offset", "hash")).alias("last"), F.count(F.lit(1)).alias("event_count"))
    clocks = log.groupBy(stream, "signer").agg(F.max("clock").alias("n")).groupBy(stream).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signer", "n")))).alias("clocks"))
    return last.join(clocks, stream).select(stream, F.col("last.offset").alias("head_offset"), F.col("last.hash").alias("prev_hash"), "clocks", "event_count")


def at_offset(log: DataFrame, offset: int) -> DataFrame:
    return log.where(F.col("offset") == offset)


def offset_of(log: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, offset) of the wanted hashes, null for those that the log lacks."""
    return hashes.join(log.select("hash", "offset"), "hash", "left")


def verify_chain(chained: DataFrame, stream: str) -> DataFrame:
    """(stream, offset, linked): does each row's prev_hash equal the hash before it?"""
    before = F.lag("hash").over(Window.partitionBy(stream).orderBy("offset"))
    return chained.withColumn("linked", F.col("prev_hash") == F.coalesce(before, F.lit(GENESIS)))


def subscription(log: DataFrame, wanted: Column, done: DataFrame, bookmark: int, batch: int = 100) -> DataFrame:
    """The next batch of a handler: wanted events from its bookmark on, but for the ones it has already handled."""
    return log.where((F.col("offset") >= bookmark) & wanted).join(done.select("offset", "event_id"), ["offset", "event_id"], "left_anti").orderBy("offset").limit(max(1, batch))


def keep_last(keys: DataFrame, handler: str, order: str, most: int) -> DataFrame:
    w = Window.partitionBy(handler).orderBy(F.desc(order))
    return keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def schema_errors(payload: Column, required: dict[str, str]) -> Column:
    """The first required field that is missing or of another type (long, double, boolean or string), null if none; not_json for no object."""
    parsed = F.try_parse_json(payload)
    checks = [F.when(F.try_variant_get(parsed, f"$.{k}", t).isNull(), F.lit(k)) for k, t in required.items()]
    return F.when(parsed.isNull(), "not_json").otherwise(F.coalesce(*checks, F.lit(None).cast("string")))


class Schemas:
    """Required fields of payloads, by type and version."""

    def __init__(self):
        self.held: dict[tuple[str, int], dict[str, str]] = {}

    def register(self, title: str, version: int, required: dict[str, str]) -> Schemas:
        if not title or version is None:
            raise ValueError("a schema has a title and a version")
        self.held[title, version] = dict(required)
        return self

    def error(self, kind: Column, version: Column, payload: Column) -> Column:
        """Null for a payload that fits its type's and version's schema."""
        out = None
        for (title, number), required in self.held.items():
            own = (kind == title) & (version == number)
            out = F.when(own, schema_errors(payload, required)) if out is None else out.when(own, schema_errors(payload, required))
        missing = F.lit("schema_not_found")
        return missing if out is None else out.otherwise(missing)
