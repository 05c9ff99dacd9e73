"""Network and stream queries: events are messages, connections and responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.catalogue import query
from lodestone.functions import ids, strings
from lodestone.operators import network
from lodestone.streaming import queries

NOW = 1705276800000
MESSAGES = """messages as (select event_id id, event_type topic, (epoch_us(ts) // 1000) ts_ms, (user_id % 4) * 86400 ttl, case when event_id % 50 = 0 then 2 else 1 end version, props, user_id from events)"""


def messages(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), ms.alias("ts_ms"), ((F.col("user_id") % 4) * 86400).alias("ttl"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).alias("version"), "props", "user_id")


@query("message_history", f"""with {MESSAGES} select id, ts_ms from messages where topic = 'click' and not (ttl > 0 and {NOW} > ts_ms + ttl * 1000) and ts_ms >= 1704500000000 order by ts_ms, id limit 50""")
def _(t):
    return network.history(messages(t), "click", NOW, 1704500000000, 50).select("id", "ts_ms")


@query("message_expiry", f"""with {MESSAGES} select id, ttl > 0 and {NOW} > ts_ms + ttl * 1000 expired from messages""")
def _(t):
    return messages(t).select("id", network.expired(F.col("ts_ms"), F.col("ttl"), F.lit(NOW)).alias("expired"))


@query("message_cleanup", f"""with {MESSAGES} select id from messages where ts_ms + 300000 >= {NOW}""")
def _(t):
    return network.cleanup(messages(t), NOW).select("id")


@query("router_stats", f"""with {MESSAGES}, r as (select topic, case when version <> 1 or strlen(props) > 8 then 'i' when ttl > 0 and {NOW} > ts_ms + ttl * 1000 then 'e' else 'd' end o from messages)
    select topic, count(*) received, count(*) filter (where o = 'd') delivered, count(*) filter (where o = 'e') dropped_expired, count(*) filter (where o = 'i') dropped_invalid from r group by 1""")
def _(t):
    return network.router_stats(network.routed(messages(t), NOW, 8))


@query("message_ids", f"""with {MESSAGES} select id, substr(sha256(user_id || '' || ts_ms || props), 1, 32) message_id from messages""")
def _(t):
    return messages(t).select("id", ids.message_id(F.col("user_id").cast("string"), F.col("ts_ms"), F.col("props")).alias("message_id"))


@query("topic_parse", """select 'net/1/updates/' || event_type topic, 'updates' kind, event_type "name" from events group by event_type union all select 'net/1/search', 'search', null union all select 'other/search', null, null""")
def _(t):
    names = t.events.select("event_type").distinct()
    made = names.select(strings.topic_string(F.lit("updates"), F.col("event_type"), "net/1").alias("topic"))
    fixed = t.spark.sql("select explode(array('net/1/search', 'other/search')) topic")
    return made.unionByName(fixed).withColumn("p", strings.topic_parse(F.col("topic"), "net/1")).select("topic", "p.kind", "p.name")


ANNOUNCED = """a as (select event_id id, case when event_id % 20 = 0 then 2 else 1 end version, case event_id % 7 when 0 then '' when 1 then 'bafk' || event_id else 'bafy' || event_id % 200 end cid, 'p' || user_id publisher_peer_id,
    'p' || case when event_id % 11 = 0 then 0 else user_id end sender, case when event_id % 13 = 0 then 0 else 100 end size, 1000 + event_id % 400 "timestamp", case when event_id % 17 = 0 then '' else 'did' end publisher_did, case when event_id % 19 = 0 then '' else 't' end title, ts, user_id from events)"""
ERRORS = """case when version <> 1 then 'unsupported_version' when cid = '' then 'empty_cid' when not starts_with(cid, 'bafy') and not starts_with(cid, 'Qm') then 'invalid_cid' when publisher_peer_id <> sender then 'peer_mismatch' when size <= 0 then 'invalid_size'
    when abs(1050 - "timestamp") > 300 then 'timestamp_drift' when publisher_did = '' then 'empty_publisher_did' when title = '' then 'empty_title' end"""


def announced(t):
    e = F.col("event_id")
    peer = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    return t.events.select(
        e.alias("id"), F.when(e % 20 == 0, 2).otherwise(1).alias("version"), F.when(e % 7 == 0, "").when(e % 7 == 1, F.concat(F.lit("bafk"), e.cast("string"))).otherwise(F.concat(F.lit("bafy"), (e % 200).cast("string"))).alias("cid"),
        peer.alias("publisher_peer_id"), F.when(e % 11 == 0, "p0").otherwise(peer).alias("sender"), F.when(e % 13 == 0, 0).otherwise(100).alias("size"), (1000 + e % 400).alias("timestamp"),
        F.when(e % 17 == 0, "").otherwise("did").alias("publisher_did"), F.when(e % 19 == 0, "").otherwise("t").alias("title"), "ts", "user_id",
    ).withColumn("error", network.announcement_error(F.lit(1050)))


@query("announcement_validate", f"""with {ANNOUNCED} select id, {ERRORS} error from a""")
def _(t):
    return announced(t).select("id", "error")


@query("discovery_dedup", f"""with {ANNOUNCED} select cid, min(id) id from a where {ERRORS} is null and cid not in ('bafy5', 'bafy6') group by cid""")
def _(t):
    known = t.spark.sql("select explode(array('bafy5', 'bafy6')) cid")
    return network.discover(announced(t).where("error is null"), known, ["id"]).select("cid", "id")


RATED = """n as (select user_id, event_id, (epoch_us(ts) // 1000) ms, row_number() over (partition by user_id order by ts, event_id) i from events),
    s as (select user_id, event_id, i, ms anchor, 1 used, true allowed from n where i = 1
      union all select n.user_id, n.event_id, n.i, case when n.ms - s.anchor >= 21600000 then n.ms else s.anchor end, case when n.ms - s.anchor >= 21600000 then 1 when s.used < 5 then s.used + 1 else s.used end, n.ms - s.anchor >= 21600000 or s.used < 5
      from s join n on n.user_id = s.user_id and n.i = s.i + 1)"""


@query("rate_limit_anchored", f"""with recursive {RATED} select user_id, event_id, allowed from s""")
def _(t):
    rows = messages(t).select("user_id", "ts_ms", F.col("id").alias("event_id"))
    return network.rate_limited(rows, "user_id", "ts_ms", "event_id", 5, 6 * 3600 * 1000)


@query("provider_metadata", """select l_partkey cid, min(l_shipdate) first_provided, max(l_shipdate) last_announced, count(*) announcement_count from lineitem group by 1""")
def _(t):
    return network.provider_metadata(t.lineitem.select(F.col("l_partkey").alias("cid"), F.col("l_shipdate").alias("ts")))


@query("announcement_outcomes", """select l_orderkey "key", count(*) filter (where l_returnflag = 'N') succeeded, count(*) filter (where l_returnflag <> 'N') failed, bool_or(l_returnflag = 'N') any_ok, bool_and(l_returnflag = 'N') all_ok from lineitem group by 1""")
def _(t):
    return network.outcomes(t.lineitem.select(F.col("l_orderkey").alias("key"), (F.col("l_returnflag") == "N").alias("ok")), "key")


KINDS = "case event_type when 'click' then 'established' when 'view' then 'activity' when 'error' then 'failed' when 'signup' then 'closed' else 'activity' end"


def connections(t):
    kind = F.when(F.col("event_type") == "click", "established").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "closed").otherwise("activity")
    return t.events.select(F.col("user_id").alias("peer"), kind.alias("kind"), F.col("event_id").alias("ts"), (F.col("event_id") % 5).alias("address"), F.when(F.col("event_id") % 2 == 0, "inbound").otherwise("outbound").alias("direction"))


FOLD = f"""c as (select user_id peer, {KINDS} kind, event_id ts, event_id % 5 address from events),
    f as (select peer, count(*) filter (where kind = 'established') connection_count, greatest(count(*) filter (where kind = 'established') - 1, 0) reconnections, count(distinct address) addresses, min(ts) first_seen, max(ts) last_seen from c group by 1)"""


@query("peer_fold", f"""with {FOLD} select * from f""")
def _(t):
    return network.peer_fold(connections(t))


FAILS = """s as (select *, max(case when kind = 'established' then ts end) over (partition by peer) last_ from c), fails as (select peer, count(*) filter (where kind = 'failed' and (last_ is null or ts > last_)) failures, max(last_) last_success from s group by 1)"""


@query("peer_failures", f"""with {FOLD}, {FAILS} select peer, failures from fails""")
def _(t):
    return network.failures_since_success(connections(t))


@query("peer_purge", f"""with {FOLD}, {FAILS} select peer from fails where failures < 2 and not (peer % 3 <> 0 and (last_success is null or 10000 - last_success > 200))""")
def _(t):
    c = connections(t)
    last = c.groupBy("peer").agg(F.max(F.when(F.col("kind") == "established", F.col("ts"))).alias("last_success"))
    peers = network.failures_since_success(c).join(last, "peer").withColumn("connected", F.col("peer") % 3 == 0)
    return network.purge(peers, F.lit(10000), 2, 200).select("peer")


@query("network_stats", f"""with {FOLD} select count(*) filter (where peer % 3 = 0) connected_peers, count(*) known_peers, sum(connection_count)::bigint total_connections, sum(reconnections)::bigint total_reconnections from f""")
def _(t):
    return network.network_stats(network.peer_fold(connections(t)).withColumn("connected", F.col("peer") % 3 == 0))


@query("peer_merge", """with f as (select user_id peer, event_id % 2 h, count(*) n, list_sort(list_distinct(list(event_id % 5))) a from events group by 1, 2)
    select peer, max(n) reconnections, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') addresses from f group by 1""")
def _(t):
    half = lambda h: t.events.where(f"event_id % 2 = {h}").groupBy(F.col("user_id").alias("peer")).agg(F.count(F.lit(1)).alias("reconnections"), F.collect_set(F.col("event_id") % 5).alias("addresses"))
    return network.merge_peers(half(0), half(1)).withColumn("addresses", F.array_join(F.transform("addresses", lambda a: a.cast("string")), ","))


@query("admission", """select event_id, user_id % 40 < case when event_id % 2 = 0 then 20 else 30 end or false admitted from events""")
def _(t):
    return t.events.select("event_id", network.may_accept(F.col("user_id") % 40, F.col("event_id") % 2 == 0, 30, 10, "prefer_outbound").alias("admitted"))


ADMITTED = f"""c as (select user_id % 8 node, event_id, {KINDS} kind, event_id % 2 = 0 inbound from events), n as (select *, row_number() over (partition by node order by event_id) i from c),
    s as (select node, event_id, i, case when kind = 'established' then 1 else 0 end active, case when kind = 'established' then true end admitted from n where i = 1
      union all select n.node, n.event_id, n.i, case when n.kind = 'established' then s.active + case when s.active < case when n.inbound then 7 else 10 end then 1 else 0 end when n.kind = 'closed' then greatest(s.active - 1, 0) else s.active end,
        case when n.kind = 'established' then s.active < case when n.inbound then 7 else 10 end end from s join n on n.node = s.node and n.i = s.i + 1)"""


@query("admission_running", f"""with recursive {ADMITTED} select node, event_id, admitted from s where admitted is not null""")
def _(t):
    c = connections(t).withColumn("node", F.col("peer") % 8).withColumnRenamed("ts", "event_id")
    return network.admit(c, "node", "event_id", 10, 3, "prefer_outbound").where("admitted is not null")


@query("dial_eligibility", f"""with {FOLD}, {FAILS} select peer, failures < 3 and ts_gap >= 1000 * power(2, least(failures, 10)) due from (select peer, failures, 10000 - last_success ts_gap from fails)""")
def _(t):
    c = connections(t)
    last = c.groupBy("peer").agg(F.max(F.when(F.col("kind") == "established", F.col("ts"))).alias("last_success"))
    peers = network.failures_since_success(c).join(last, "peer")
    return peers.select("peer", network.retry_due(F.col("failures"), 10000 - F.col("last_success"), 3).alias("due"))


@query("live_query_gather", """with q as (select event_id query_id, (epoch_us(ts) // 1000) q_ts, user_id from events where event_type = 'signup'), r as (select event_id response_id, (epoch_us(ts) // 1000) r_ts, user_id from events where event_type = 'click')
    select query_id, response_id, row_number() over (partition by query_id order by r_ts, response_id) "rank" from q join r using (user_id) where r_ts between q_ts and q_ts + 43200000 qualify "rank" <= 3""")
def _(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    q = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("query_id"), ms.alias("q_ts"), "user_id")
    r = t.events.where("event_type = 'click'").select(F.col("event_id").alias("response_id"), ms.alias("r_ts"), "user_id")
    return network.gather(q, r, 43200000, 3, "user_id").select("query_id", "response_id", "rank")


@query("provider_accumulation", """with q as (select o_orderkey query_id, o_orderkey % 50 asked_at from orders), b as (select l_orderkey query_id, l_suppkey provider, l_orderkey % 50 + l_quantity::int "at" from lineitem)
    select query_id, count(distinct case when "at" - asked_at <= 20 then provider end) providers, case when count(case when "at" - asked_at <= 20 then 1 end) > 0 then 'found' when 60 - asked_at > 20 then 'timeout' else 'pending' end status from q left join b using (query_id) group by query_id, asked_at""")
def _(t):
    q = t.orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 50).alias("asked_at"))
    b = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("provider"), (F.col("l_orderkey") % 50 + F.bround("l_quantity", 0).cast("int")).alias("at"))
    return network.accumulated(q, b, F.lit(60), 20)


@query("message_throughput", f"""with {MESSAGES} select topic, count(*) messages, round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000), 6) per_second from messages group by 1""")
def _(t):
    return network.throughput(messages(t), "topic").withColumn("per_second", F.round("per_second", 6))


@query("latency_stats", """select l_returnflag route, round(avg(l_quantity), 6) avg_ms, min(l_quantity) min_ms, max(l_quantity) max_ms, count(*) messages from lineitem group by 1""")
def _(t):
    return network.latency(t.lineitem.select(F.col("l_returnflag").alias("route"), F.col("l_quantity").alias("latency_ms")), "route").withColumn("avg_ms", F.round("avg_ms", 6))


@query("late_data", f"""with {MESSAGES} select id, abs({NOW} - ts_ms) > 300000 drifted from messages""")
def _(t):
    return messages(t).select("id", (F.abs(F.lit(NOW) - F.col("ts_ms")) > 300000).alias("drifted"))


def streamed(t, plan, close: bool = False):
    """The result of a stream over the events, run to its end: batches are appended as files under the session's shared folder. close: a last row ends the windows that are still open."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    source, finish = source.withColumn("ts", F.col("ts").cast("timestamp")), None
    if close:
        source, finish = queries.closing(source, "ts")
    return queries.run_to_files(plan(source), finish)


@query("stream_tumbling", """select time_bucket(interval 6 hours, ts) "start", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def _(t):
    from lodestone.streaming import queries as q

    return streamed(t, lambda s: q.tumbling(s, "ts", "6 hours", "event_type"), close=True).withColumn("total", F.round("total", 4))


@query("stream_dedup", """select event_type, user_id, count(*) n from (select distinct user_id, event_type from events) group by 1, 2""")
def _(t):
    from lodestone.streaming import queries as q

    return streamed(t, lambda s: q.deduplicated(s, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_session", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 4 hours then 0 else 1 end new_ from events), s as (select *, sum(new_) over (partition by user_id order by ts) k from g)
    select user_id, min(ts) "start", max(ts) + interval 4 hours "end", count(*) n from s group by user_id, k""")
def _(t):
    from lodestone.streaming import queries as q

    return streamed(t, lambda s: q.sessions(s, "ts", "4 hours", "user_id"), close=True)


@query("stream_rate_limit", f"""with recursive {RATED} select user_id, event_id, allowed from s""")
def _(t):
    from lodestone.streaming import queries as q

    return streamed(t, lambda s: q.rate_limited(s.select("user_id", "event_id", F.unix_millis("ts").alias("ts_ms")), "user_id", 5, 6 * 3600 * 1000))


@query("stream_admission", f"""with recursive {ADMITTED} select node, event_id, admitted from s where admitted is not null""")
def _(t):
    from lodestone.streaming import queries as q

    kind = F.when(F.col("event_type") == "click", "established").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "closed").otherwise("activity")
    rows = lambda s: s.select((F.col("user_id") % 8).alias("node"), "event_id", kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "inbound").otherwise("outbound").alias("direction"))
    return streamed(t, lambda s: q.admitted(rows(s), "node", "event_id", 10, 3, "prefer_outbound")).where("admitted is not null")


@query("stream_lifecycle", f"""with recursive {FOLD}, n as (select *, row_number() over (partition by peer order by ts) i from c),
    s as (select peer, i, case when kind = 'established' then 1 else 0 end connections, kind = 'established' known, 0 reconnections from n where i = 1
      union all select n.peer, n.i, case n.kind when 'established' then s.connections + 1 when 'closed' then greatest(s.connections - 1, 0) else s.connections end, s.known or n.kind = 'established', s.reconnections + case when n.kind = 'established' and (s.connections > 0 or s.known) then 1 else 0 end from s join n on n.peer = s.peer and n.i = s.i + 1)
    select peer, max(reconnections)::bigint reconnections, arg_max(connections, i)::bigint connections from s group by peer""")
def _(t):
    from lodestone.streaming import queries as q

    kind = F.when(F.col("event_type") == "click", "established").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "closed").otherwise("activity")
    out = streamed(t, lambda s: q.lifecycles(s.select(F.col("user_id").alias("peer"), "event_id", kind.alias("kind")), "peer", "event_id"))
    return out.groupBy("peer").agg(F.max("reconnections").alias("reconnections"), F.max_by("connections", "event_id").alias("connections"))


@query("stream_gather", """with q as (select event_id q_id, ts, user_id from events where event_type = 'signup'), r as (select event_id r_id, ts r_ts, user_id from events where event_type = 'click') select q_id, r_id from q join r using (user_id) where r_ts >= ts and r_ts <= ts + interval 6 hours""")
def _(t):
    from lodestone.streaming import queries as q

    def plan(s):
        asked = s.where("event_type = 'signup'").select(F.col("event_id").alias("query"), F.col("user_id").alias("q_id"), F.col("ts").alias("q_ts"))
        told = s.where("event_type = 'click'").select(F.col("event_id").alias("response"), F.col("user_id").alias("r_id"), F.col("ts").alias("r_ts"))
        return q.gather(asked, told, "6 hours", "12 hours").select(F.col("query").alias("q_id"), F.col("response").alias("r_id"))

    return streamed(t, plan)


@query("stream_router", f"""with {MESSAGES}, r as (select topic, case when version <> 1 or strlen(props) > 8 then 'i' when ttl > 0 and {NOW} > ts_ms + ttl * 1000 then 'e' else 'd' end o from messages)
    select topic, count(*) received, count(*) filter (where o = 'd') delivered from r group by 1""")
def _(t):
    """Routed batch by batch; the counts of all batches together."""
    import uuid

    base = f"{queries.folder(t.spark)}/{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    rows = source.select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), ((F.col("user_id") % 4) * 86400).alias("ttl"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).alias("version"), "props", "user_id")
    queries.route(rows, NOW, 8, f"{base}/store", f"{base}/stats", f"{base}/checkpoint").start().awaitTermination()
    return t.spark.read.parquet(f"{base}/stats").groupBy("topic").agg(F.sum("received").alias("received"), F.sum("delivered").alias("delivered"))


@query("stream_topics", """select event_id, user_id from events where event_type = 'error'""")
def _(t):
    from lodestone.streaming import queries as q

    return streamed(t, lambda s: q.topics(s.withColumn("topic", F.col("event_type")), ["error"])["error"].select("event_id", "user_id"))


SESSION_MS, ANSWERS_MS = 7_200_000, 14_400_000


@query("stream_challenges", f"""with e as (select user_id "key", event_id id, epoch_us(ts) // 1000 ms, event_type in ('click', 'signup') issue from events),
    p as (select *, lag(ms) over w prev_ms, lag(id) over w prev_id, coalesce(lag(issue) over w, false) open, lead(ms) over w is null last from e window w as (partition by "key" order by ms, id))
    select "key", id, ms ts_ms, case when issue then 'issued' when open and ms - prev_ms <= {SESSION_MS} then 'accepted' else 'missing' end outcome from p
    union all select "key", prev_id, prev_ms + {SESSION_MS}, 'expired' from p where open and ms - prev_ms > {SESSION_MS}
    union all select "key", id, ms + {SESSION_MS}, 'expired' from p where last and issue and ms + {SESSION_MS} < (select max(ms) from e)""")
def _(t):
    """Clicks and sign-ups issue a user's challenge, any other event finishes one; what is left open expires by its timer."""
    from lodestone.streaming import timers

    kind = F.when(F.col("event_type").isin("click", "signup"), "issue").otherwise("finish")
    return streamed(t, lambda s: timers.challenges(s.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind")), SESSION_MS))


@query("stream_gather_stop", f"""with e as (select user_id || '/' || (epoch_us(ts) // 86400000000) "key", event_id id, epoch_us(ts) // 1000 ms, event_type = 'signup' asks, event_id % 7 peer, event_id % 5 n from events),
    q as (select "key", min({{'ms': ms, 'id': id}}) first from e where asks group by "key"),
    a as (select e."key", q.first.ms opened, e.ms, e.id, e.n, row_number() over (partition by e."key", peer order by e.ms, e.id) again from e join q using ("key") where not asks and {{'ms': e.ms, 'id': e.id}} > q.first and e.ms - q.first.ms <= {ANSWERS_MS}),
    k as (select *, row_number() over (partition by "key" order by ms, id) r from a where again = 1),
    s as (select q."key", q.first.ms opened, count(k.id) peers, coalesce(sum(k.n), 0)::bigint results, max(k.ms) filter (where r = 3) enough from q left join k on k."key" = q."key" and r <= 3 group by all),
    late as (select distinct e."key" from e join q using ("key") where not asks and e.ms - q.first.ms > {ANSWERS_MS})
    select "key", peers, results, opened first_ms, coalesce(enough, opened + {ANSWERS_MS}) done_ms, case when enough is null then 'timeout' else 'enough' end reason from s
    where enough is not null or opened + {ANSWERS_MS} + 1 < (select max(ms) from e) or "key" in (select "key" from late)""")
def _(t):
    """A user's first sign-up of a day asks, other events of that day answer: three peers are enough, and four hours."""
    from lodestone.streaming import timers

    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.expr("cast(unix_micros(ts) div 86400000000 as string)"))
    kind = F.when(F.col("event_type") == "signup", "query").when(F.col("event_type").isNotNull(), "answer")
    return streamed(t, lambda s: timers.gathered(s.select(key.alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind"), (F.col("event_id") % 7).alias("peer"), (F.col("event_id") % 5).alias("results")), 3, ANSWERS_MS))


@query("stream_lag", """with recursive e as (select user_id % 20 "key", event_id id, event_id % 3 <> 0 message, row_number() over (partition by user_id % 20 order by epoch_us(ts) // 1000, event_id) r from events),
    s as (select "key", id, r, message, case when message then 1 else 0 end sent, 0 taken, 0 lost, case when message then 'kept' else 'empty' end outcome, 0 lag, null::bigint place from e where r = 1
      union all select e."key", e.id, e.r, e.message, s.sent + case when e.message then 1 else 0 end,
        case when e.message then greatest(s.taken, s.sent + 1 - 5) when s.sent > s.taken then s.taken + 1 else s.taken end,
        case when e.message then s.lost + greatest(0, s.sent + 1 - 5 - s.taken) when s.sent > s.taken then 0 else s.lost end,
        case when e.message then 'kept' when s.sent = s.taken then 'empty' when s.lost > 0 then 'lagged' else 'read' end, case when e.message or s.sent = s.taken then 0 else s.lost end, case when not e.message and s.sent > s.taken then s.taken + 1 end
      from s join e on e."key" = s."key" and e.r = s.r + 1),
    m as (select "key", id, row_number() over (partition by "key" order by r) place from e where message)
    select s."key", s.id, s.outcome, s.lag::bigint lag, m.id got from s left join m on m."key" = s."key" and m.place = s.place""")
def _(t):
    """Twenty subscribers with buffers of five: two messages come for each read."""
    from lodestone.streaming import timers

    kind = F.when(F.col("event_id") % 3 != 0, "message").otherwise("read")
    return streamed(t, lambda s: timers.buffered(s.select((F.col("user_id") % 20).alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind")), 5))


@query("stream_dispatch", """with log as (select *, row_number() over (order by ts, event_id) - 1 "offset" from events)
    select 'clicks' "handler", event_id, "offset" from log where event_type = 'click' union all select 'large', event_id, "offset" from log where value > 20""")
def _(t):
    """The whole log in two segments, dispatched to two handlers from bookmarks of their own, the second segment by another dispatcher."""
    from lodestone.streaming import dispatch

    spark, base = t.spark, f"{queries.folder(t.spark)}/{uuid.uuid4().hex}"
    half = t.events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0] or 0
    early = F.unix_micros(F.col("ts").cast("timestamp")) < half

    def writes(name):
        return lambda rows: rows.select("event_id", "offset").write.mode("append").parquet(f"{base}/out/handler={name}")

    for part in (t.events.where(early), t.events.where(~early)):
        dispatch.append(part.withColumn("ts", F.col("ts").cast("timestamp")), f"{base}/log")
        both = dispatch.Dispatcher(spark, f"{base}/log", f"{base}/state", batch=1 << 16)
        both.register("clicks", writes("clicks"), F.col("event_type") == "click").register("large", writes("large"), F.col("value") > 20).poll()
    return spark.read.schema("event_id long, offset long, handler string").parquet(f"{base}/out").select("handler", "event_id", "offset")
