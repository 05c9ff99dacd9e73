"""Event-log queries: user_id is the actor, event_type the stream or topic, props the payload."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.catalogue import query
from lodestone.functions import jsonschema
from lodestone.operators import events


def log(t):
    return events.append_offsets(t.events)


LOG = """log as (select *, row_number() over (order by ts, event_id) - 1 "offset" from events)"""


@query("event_append_offsets", f"""with {LOG} select event_id, "offset" from log""")
def _(t):
    return log(t).select("event_id", "offset")


@query("event_stream_offsets", """select event_id, row_number() over (partition by event_type order by ts, event_id) - 1 "offset" from events""")
def _(t):
    return events.append_offsets(t.events, stream="event_type").select("event_id", "offset")


@query("event_range", f"""with {LOG} select "offset", event_id from log where "offset" >= 100 and "offset" < 180""")
def _(t):
    return events.between(log(t), 100, 180).select("offset", "event_id")


@query("event_head", f"""with {LOG} select max("offset") head_offset, count(*) event_count from log""")
def _(t):
    return events.head(log(t))


@query("event_causality_running", """select event_id, count(*) over (partition by event_type, user_id order by event_id rows unbounded preceding) clock from events""")
def _(t):
    return events.running_causality(t.events.withColumn("offset", F.col("event_id")), "event_type", "user_id").select("event_id", "clock")


CLOCKS = """clocks as (select event_id, event_type, map {'a': user_id % 4, 'b': event_id % 3} m, map {'a': 2, 'b': 1, 'c': 1} o from events)"""


def clocks(t):
    pair = F.create_map(F.lit("a"), F.col("user_id") % 4, F.lit("b"), F.col("event_id") % 3)
    return t.events.select("event_id", "event_type", pair.alias("clocks"), F.expr("map('a', 2L, 'b', 1L, 'c', 1L)").alias("other"))


@query("dvv_merge", """select event_type, 'a' actor, max(user_id % 4) clock from events group by 1 union all select event_type, 'b', max(event_id % 3) from events group by 1""")
def _(t):
    return events.merge_clocks(clocks(t), "event_type")


@query("dvv_relations", """select event_id, user_id % 4 <= 2 and event_id % 3 <= 1 precedes, not (user_id % 4 <= 2 and event_id % 3 <= 1) concurrent, greatest(user_id % 4, 2)::bigint merged_a, event_id % 3 + 1 next_b from events""")
def _(t):
    c, o = F.col("clocks"), F.col("other")
    return clocks(t).select("event_id", events.precedes(c, o).alias("precedes"), events.concurrent(c, o).alias("concurrent"), events.merged(c, o)["a"].alias("merged_a"), events.incremented(c, F.lit("b"))["clocks"]["b"].alias("next_b"))


def schemas():
    out = events.Schemas().register("click", 1, {"k": "long"}).register("view", 1, {"k": "long"}).register("error", 1, {"k": "long", "message": "string"})
    return out.register("purchase", 1, {"k": "long"}).register("purchase", 2, {"k": "long"})


def offered(t):
    """Events as signed payloads: actors are streams and signers; some have no signature, no schema, or a field too few."""
    e = F.col("event_id")
    return t.events.select(
        "event_id", F.col("user_id").alias("stream"), F.col("event_type").alias("type"), F.when(e % 9 == 0, 2).otherwise(1).alias("schema_version"), F.col("props").alias("payload"), "ts",
        F.concat(F.lit("did:key:"), (F.col("user_id") % 2 + e % 3).cast("string")).alias("signer"), F.when(e % 14 == 0, "").otherwise("s").alias("sig"), F.lit("ed25519").alias("sig_type"),
    )


REFUSED = """case when event_type = 'signup' or (event_id % 9 = 0 and event_type <> 'purchase') then 'schema_not_found' when event_type = 'error' then 'message' when event_id % 14 = 0 then 'invalid_payload' end"""
APPENDED = f"""good as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 "offset", 'did:key:' || (user_id % 2 + event_id % 3) signer from events where {REFUSED} is null),
    clocked as (select *, row_number() over (partition by user_id, signer order by "offset") clock from good),
    bodies as (select *, '{{"causality":{{"clocks":{{"' || signer || '":' || clock || '}},"dots":[["' || signer || '",' || clock || ']]}},"id":"' || event_id || '","payload":' || props || ',"prev_hash":"' head,
      '","redactable":false,"schema_version":' || case when event_id % 9 = 0 then 2 else 1 end || ',"signer":"' || signer || '","trust_refs":[],"ts":' || (epoch_us(ts) // 1000) || ',"type":"' || event_type || '"}}' tail from clocked),
    linked as (select user_id, "offset", event_id, clock, repeat('0', 64) prev_hash, sha256(head || repeat('0', 64) || tail) hash from bodies where "offset" = 0
      union all select b.user_id, b."offset", b.event_id, b.clock, l.hash, sha256(b.head || l.hash || b.tail) from linked l join bodies b on b.user_id = l.user_id and b."offset" = l."offset" + 1)"""


def appended(t):
    return events.append(offered(t), schemas())[0]


@query("event_append", f"""with recursive {APPENDED} select event_id, user_id stream, "offset", clock, prev_hash, hash from linked""")
def _(t):
    return appended(t).select("event_id", "stream", "offset", "clock", "prev_hash", "hash")


@query("event_refused", f"""select event_id, {REFUSED} error from events where {REFUSED} is not null""")
def _(t):
    return events.append(offered(t), schemas())[1].select("event_id", "error")


@query("event_stream_heads", f"""with recursive {APPENDED}, c as (select user_id, signer, max(clock) n from clocked group by all)
    select user_id stream, max("offset") head_offset, arg_max(hash, "offset") prev_hash, count(*) event_count, (select string_agg(signer || '=' || n, ',' order by signer) from c where c.user_id = linked.user_id) clocks from linked group by user_id""")
def _(t):
    pairs = F.transform(F.map_entries("clocks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return events.heads(appended(t)).select("stream", "head_offset", "prev_hash", "event_count", F.array_join(pairs, ",").alias("clocks"))


@query("event_offset_by_hash", f"""with recursive {APPENDED} select sha256('x' || doc_id) hash, null::bigint "offset" from documents union all select hash, "offset" from linked where user_id = 7""")
def _(t):
    log = appended(t).where("stream = 7")
    odd = t.documents.select(F.sha2(F.concat(F.lit("x"), F.col("doc_id").cast("string")), 256).alias("hash"))
    return events.offset_of(log, log.select("hash").unionByName(odd))


@query("event_get", f"""with {LOG} select "offset", event_id, event_type from log where "offset" = 42""")
def _(t):
    return events.at_offset(log(t), 42).select("offset", "event_id", "event_type")


@query("event_chain_verify", f"""with recursive {APPENDED} select user_id stream, count(*) n, true whole from linked group by 1""")
def _(t):
    return events.verify_chain(appended(t), "stream").groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.every("linked").alias("whole"))


@query("event_chain_tampered", f"""with {LOG} select event_type, count(*) n, count(*) filter (where event_id % 100 = 7) broken from log group by 1""")
def _(t):
    made = t.events.select("event_id", "event_type", F.col("event_id").alias("offset"), F.lit("").alias("head"), F.col("props").alias("tail"))
    built = events.chain(made, "event_type").withColumn("prev_hash", F.when(F.col("offset") % 100 == 7, F.lit("other")).otherwise(F.col("prev_hash")))
    return events.verify_chain(built, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("linked")).alias("broken"))


@query("event_schema_validate", """select event_id, case when event_id % 10 = 0 then 'message' end error from events""")
def _(t):
    payload = F.when(F.col("event_id") % 10 == 0, F.col("props")).otherwise(F.concat(F.lit('{"message":"m",'), F.substring("props", 2, 100)))
    return t.events.select("event_id", events.schema_errors(payload, {"message": "string", "k": "long"}).alias("error"))


PAYLOAD = """'{"user":' || user_id || ',"kind":"' || event_type || '","amount":' || value || ',"props":' || props || ',"tags":["' || event_type || '",' || case when event_id % 9 = 0 then '7' else '"t"' end || '],"note":' ||
    case event_id % 5 when 0 then 'null' when 1 then '""' else '"n' || event_id || '"' end || case when event_id % 11 = 0 then ',"extra":1' else '' end || '}'"""


def compiled() -> jsonschema.SchemaRegistry:
    """Two versions of an event's schema: the second is laxer, and leaves more to nested parts."""
    first = {
        "title": "event", "version": 1, "type": "object", "required": ["user", "kind", "amount"],
        "properties": {
            "kind": {"enum": ["click", "view", "error", "purchase"]}, "amount": {"type": "number", "minimum": 1, "exclusiveMaximum": 60}, "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 95}}},
            "tags": {"type": "array", "items": {"type": "string"}, "minItems": 2, "uniqueItems": True}, "user": {"type": "integer"}, "note": {"anyOf": [{"type": "null"}, {"type": "string", "minLength": 1}]},
        },
        "additionalProperties": False,
    }
    second = {
        "title": "event", "version": 2, "$defs": {"even": {"type": "integer", "multipleOf": 2}}, "type": "object", "properties": {"props": {"properties": {"k": {"$ref": "#/$defs/even"}}}, "note": {"type": ["string", "null"], "pattern": "^$|[0-8]$"}},
        "if": {"properties": {"kind": {"const": "view"}}}, "then": {"properties": {"amount": {"maximum": 20}}}, "else": {"not": {"required": ["extra"]}},
    }
    return jsonschema.SchemaRegistry().register(first).register(json.dumps(second))


@query("event_schema_compiled", f"""with e as (select *, (props::json->>'k')::bigint k, event_id % 3 + 1 version from events)
    select event_id, case
      when version = 1 then case when event_type = 'signup' then '/kind enum' when value < 1 then '/amount minimum' when value >= 60 then '/amount exclusiveMaximum' when k > 95 then '/props/k maximum'
        when event_id % 9 = 0 then '/tags/1 type' when event_id % 5 = 1 then '/note anyOf' when event_id % 11 = 0 then '/extra additionalProperties' end
      when version = 2 then case when k % 2 = 1 then '/props/k multipleOf' when event_id % 5 > 1 and event_id % 10 = 9 then '/note pattern' when event_type = 'view' and value > 20 then '/amount maximum' when event_type <> 'view' and event_id % 11 = 0 then ' not' end
      else 'schema not found' end error from e""")
def _(t):
    """Every event as a payload of one of three versions, of which two have a schema."""
    rows = t.events.select("event_id", (F.col("event_id") % 3 + 1).alias("version"), F.expr(PAYLOAD).alias("payload"))
    return rows.select("event_id", compiled().error(F.lit("event"), F.col("version"), F.col("payload")).alias("error"))


@query("payload_extract", """select event_id, (props::json->>'k')::bigint k from events""")
def _(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("subscription_process", """select event_id, event_id "offset" from events where event_id >= 500 and event_type = 'click' and event_id % 4 <> 0 order by event_id limit 100""")
def _(t):
    rows = t.events.withColumn("offset", F.col("event_id"))
    return events.subscription(rows, F.col("event_type") == "click", rows.where("event_id % 4 = 0"), 500).select("event_id", "offset")


@query("idempotency_prune", """select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) n from events) where n <= 10""")
def _(t):
    return events.keep_last(t.events.select("user_id", "event_id"), "user_id", "event_id", 10)
