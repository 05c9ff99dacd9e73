"""Queries over keyed stores, and folds over the events of a peer, node or challenge: events are changes, users are peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalogue import query
from lodestone.operators import folds, graph, network, stores
from lodestone.plans.network import FOLD, MESSAGES, NOW, connections, messages


@query("message_store", f"""with {MESSAGES}, m as (select topic || ':' || (id % 4000) id, ts_ms, props, id seq from messages) select id, max(ts_ms) ts_ms, arg_max(props, (case when seq % 3 = 0 then 0 else 1 end, ts_ms, seq)) props from m group by id""")
def _(t):
    """Every third message is held already, the others are stored after them; a later time wins within each."""
    m = messages(t).select(F.concat_ws(":", "topic", (F.col("id") % 4000).cast("string")).alias("id"), "ts_ms", "props", F.col("id").alias("seq"))
    out = stores.store_messages(m.where("seq % 3 = 0"), m.where("seq % 3 <> 0"), tie="seq")
    late = m.groupBy("id").agg(F.max("ts_ms").alias("ts_ms"))
    return out.select("id", "props").join(late, "id")


@query("message_validate", """with m as (select event_id id, event_type topic, (epoch_us(ts) // 1000) ts_ms, (user_id % 4) * 86400 ttl, case when event_id % 50 = 0 then 2 else 1 end version, props payload, 'p' || user_id source from events)
    select id, case when version <> 1 then 'invalid_version' when strlen('{"format":"json","id":"' || id || '","payload":' || to_json(payload) || ',"source":"' || source || '","timestamp":' || ts_ms || ',"topic":"' || topic || '","ttl":' || ttl || ',"version":' || version || '}') > 135 then 'too_large'
      when ttl > 0 and 1705276800000 > ts_ms + ttl * 1000 then 'expired' end error from m""")
def _(t):
    m = messages(t).select(F.col("id").cast("string").alias("id"), "topic", "ts_ms", "ttl", "version", F.col("props").alias("payload"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("source"), F.lit("json").alias("format"))
    return m.select(F.col("id").cast("long").alias("id"), network.message_error(135, F.lit(NOW)).alias("error"))


def puts(t):
    """Orders as puts of records, customers as keys; the priority's length, many times over, is the size of a value."""
    value = F.expr("repeat('v', cast(o_totalprice as int) % 200)")
    return t.orders.select(F.col("o_orderkey").alias("at"), F.col("o_custkey").alias("key"), value.alias("value"), (F.col("o_orderkey") % 5000).alias("expires"))


PUTS = """p as (select o_orderkey "at", o_custkey "key", trunc(o_totalprice)::int % 200 size, o_orderkey % 5000 expires from orders), s as (select * from p where size <= 150),
    a as (select "at", row_number() over (order by "at") n from (select min("at") "at" from s group by "key")), full_ as (select min("at") f from a where n >= 700),
    o as (select "at", "key", expires, case when size > 150 then 'value_too_large' when "at" > (select f from full_) then 'max_records' else 'stored' end outcome from p)"""


@query("record_put", f"""with {PUTS} select "at", "key", outcome from o""")
def _(t):
    new = puts(t)
    return stores.put_records(new.select("key", "value", "expires").where("false"), new, "at", 150, 700)[1]


@query("record_get", f"""with {PUTS} select "key", arg_max(expires, "at") expires from o where outcome = 'stored' group by "key" having arg_max(expires, "at") > 300""")
def _(t):
    new = puts(t)
    held = stores.put_records(new.select("key", "value", "expires").where("false"), new, "at", 150, 700)[0]
    return stores.live(held, F.lit(300)).select("key", "expires")


def provided(t, half: int):
    return t.lineitem.where(F.col("l_linenumber") % 2 == half).groupBy(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("provider")).agg(F.max("l_orderkey").alias("expires"), F.min("l_orderkey").alias("arrival"))


@query("provider_add", """with h as (select l_partkey "key", l_suppkey provider, max(l_orderkey) expires, min(l_orderkey) arrival, l_linenumber % 2 new_ from lineitem group by all),
    s as (select "key", provider, min((new_, arrival)) seen, arg_max(expires, new_) expires from h group by all)
    select "key", provider, expires from s qualify row_number() over (partition by "key" order by seen, provider) <= 5""")
def _(t):
    return stores.add_providers(provided(t, 0), provided(t, 1), "arrival", 5).select("key", "provider", "expires")


@query("provider_live", """with h as (select l_partkey "key", l_suppkey provider, max(l_orderkey) expires from lineitem where l_linenumber % 2 = 0 group by all) select * from h where expires > 7000""")
def _(t):
    return stores.live(provided(t, 0), F.lit(7000)).select("key", "provider", "expires")


@query("peer_registry", """with l as (select user_id peer, event_id n, event_id % 7 "count", 'a' || event_id % 5 address, case event_id % 12 when 0 then 'active' when 1 then 'inactive' when 2 then 'address' when 3 then 'reconnections' when 4 then 'failures' when 5 then 'success' when 6 then 'address' when 7 then case when event_id % 7 = 0 then 'forgotten' else 'active' end else 'failures' end kind from events),
    k as (select *, max(case when kind = 'forgotten' then n end) over (partition by peer) gone from l), r as (select * from k where kind <> 'forgotten' and (gone is null or n > gone))
    select peer, coalesce(arg_max(kind = 'active', n) filter (where kind in ('active', 'inactive')), false) active, coalesce(array_to_string(list_sort(list_distinct(list(address) filter (where kind = 'address'))), ','), '') addresses,
    coalesce(arg_max("count", n) filter (where kind = 'reconnections'), 0) reconnections, coalesce(arg_max("count", n) filter (where kind = 'failures'), 0) failures, arg_max("count", n) filter (where kind = 'success') last_success from r group by peer""")
def _(t):
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["active", "inactive", "address", "reconnections", "failures", "success", "address", "forgotten", "failures", "failures", "failures", "failures"])), (e % 12 + 1).cast("int"))
    kind = F.when((kind == "forgotten") & (e % 7 != 0), "active").otherwise(kind)
    log = t.events.select(F.col("user_id").alias("peer"), e.alias("n"), (e % 7).alias("count"), F.concat(F.lit("a"), (e % 5).cast("string")).alias("address"), kind.alias("kind"))
    return stores.peers_at(log, "n").withColumn("addresses", F.array_join("addresses", ","))


@query("should_dial", """with p as (select distinct user_id peer from events), a as (select user_id peer, max(event_id) "at" from events where event_type = 'view' group by 1),
    r as (select peer, case when peer = 5 then 'self' when peer % 7 = 0 then 'connected' when peer % 5 = 0 then 'registered' when peer % 3 = 0 then 'dialing' when 10000 - "at" < 300 then 'cooldown' end reason from p left join a using (peer))
    select peer, reason is null dial, reason from r""")
def _(t):
    peers = t.events.select(F.col("user_id").alias("peer")).distinct()
    tried = t.events.where("event_type = 'view'").select(F.col("user_id").alias("peer"), F.col("event_id").alias("at"))
    return stores.should_dial(peers, F.lit(5), peers.where("peer % 7 = 0"), peers.where("peer % 5 = 0"), peers.where("peer % 3 = 0"), tried, F.lit(10000), 300)


@query("reprovide_due", """with p as (select l_partkey cid, max(l_orderkey) last_announced from lineitem group by 1) select cid from p where 16000 - last_announced >= 2000""")
def _(t):
    held = t.lineitem.groupBy(F.col("l_partkey").alias("cid")).agg(F.max("l_orderkey").alias("last_announced"))
    return stores.reprovide(held, F.lit(16000), 2000).select("cid")


@query("stale_requests", """select event_id id, 'timed out after ' || (10000 - event_id) || 's' error from events where 10000 - event_id > 30""")
def _(t):
    return stores.stale(t.events.select(F.col("event_id").alias("id"), F.col("event_id").alias("created_at")), F.lit(10000))[1]


def passkeys(t):
    """Orders as stored credentials of their customer's device; every tenth can't be read."""
    good = F.concat(F.lit('{"cred_id":"c'), (F.col("o_orderkey") % 5000).cast("string"), F.lit('","counter":'), (F.col("o_orderkey") % 9).cast("string"), F.lit("}"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("device_id"), F.when(F.col("o_orderkey") % 10 == 0, "{broken").otherwise(good).alias("json"))


KEYS = """k as (select o_orderkey id, o_custkey device_id, 'c' || o_orderkey % 5000 credential_id, o_orderkey % 9 counter from orders where o_orderkey % 10 <> 0)"""


@query("passkeys_of_device", f"""with {KEYS} select id, credential_id, counter from k where device_id = (select min(device_id) from k)""")
def _(t):
    rows = passkeys(t)
    least = rows.where("json <> '{broken'").agg(F.min("device_id")).first()[0]
    return stores.credentials(rows, F.lit(least)).select("id", "credential_id", "counter")


@query("passkey_find", f"""with {KEYS}, w as (select distinct 'c' || c_custkey credential_id from customer) select w.credential_id, min(id) id from w left join k using (credential_id) group by 1""")
def _(t):
    return stores.find_credential(passkeys(t), t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("credential_id")).distinct())


@query("passkey_count_use", f"""with {KEYS}, u as (select c_custkey device_id, 100 + c_custkey counter from customer where c_custkey % 2 = 0), f as (select device_id, min(id) id from k group by 1)
    select k.id, k.device_id, k.credential_id, coalesce(u.counter, k.counter) counter from k left join f on f.id = k.id left join u on u.device_id = f.device_id""")
def _(t):
    return stores.count_use(passkeys(t), t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("device_id"), (F.col("c_custkey") + 100).alias("counter")))


@query("kv_len", """with v as (select user_id, arg_max(event_type, event_id) e from events group by 1) select count(*) filter (where e <> 'error') len, count(*) filter (where e <> 'error') = 0 is_empty from v""")
def _(t):
    return stores.kv_summary(t.events, "user_id", F.col("event_id"), F.col("event_type") == "error", t.events.select("user_id").distinct())[0]


@query("kv_exists", """with v as (select user_id, arg_max(event_type, event_id) e from events group by 1), p as (select c_custkey user_id from customer) select p.user_id, coalesce(e <> 'error', false) found from p left join v using (user_id)""")
def _(t):
    return stores.kv_summary(t.events, "user_id", F.col("event_id"), F.col("event_type") == "error", t.customer.select(F.col("c_custkey").alias("user_id")))[1]


@query("peer_lifecycle", f"""with recursive {FOLD}, n as (select *, row_number() over (partition by peer order by ts) i from c),
    s as (select peer, ts, i, case when kind = 'established' then 1 else 0 end connections, kind = 'established' known, 0 reconnections, case when kind = 'failed' then 1 else 0 end failures from n where i = 1
      union all select n.peer, n.ts, n.i, case n.kind when 'established' then s.connections + 1 when 'closed' then greatest(s.connections - 1, 0) else s.connections end, s.known or n.kind = 'established',
        s.reconnections + case when n.kind = 'established' and (s.connections > 0 or s.known) then 1 else 0 end, case n.kind when 'established' then 0 when 'failed' then s.failures + 1 else s.failures end from s join n on n.peer = s.peer and n.i = s.i + 1)
    select peer, ts, connections::bigint connections, reconnections::bigint reconnections, failures::bigint failures from s""")
def _(t):
    return network.lifecycles(connections(t), "peer", "ts")


@query("challenge_outcomes", """with c as (select user_id, event_id, case when event_type in ('click', 'view') then 'issue' else 'finish' end kind, (epoch_us(ts) // 1000) ms from events), w as (select *, lag(kind) over p k, lag(ms) over p m from c window p as (partition by user_id order by ms, event_id))
    select user_id, event_id, case when kind = 'issue' then 'issued' when k is null or k = 'finish' then 'missing' when ms - m > 21600000 then 'expired' else 'accepted' end outcome from w""")
def _(t):
    kind = F.when(F.col("event_type").isin("click", "view"), "issue").otherwise("finish")
    rows = t.events.select("user_id", "event_id", kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    made = rows.withColumn("seq", F.col("ts_ms") * 100000 + F.col("event_id"))
    out = network.challenges(made, "user_id", "seq", 21600000)
    return out.join(made.select("user_id", "seq", "event_id"), ["user_id", "seq"]).select("user_id", "event_id", "outcome")


@query("cache_replay", """with k as (select event_id, user_id % 20 node, event_type q, (epoch_us(ts) // 1000) * 100000 + event_id seq from events), p as (select *, lag(seq) over (partition by node, q order by seq) prev from k)
    select event_id, prev is not null and (select count(distinct q) from k o where o.node = p.node and o.seq > p.prev and o.seq < p.seq and o.q <> p.q) < 3 hit from p""")
def _(t):
    """A cache of three answers a node, without a time limit: hit if fewer than three other queries came between."""
    rows = t.events.select("event_id", (F.col("user_id") % 20).alias("node"), F.col("event_type").alias("q"), (F.unix_millis(F.col("ts").cast("timestamp")) * 100000 + F.col("event_id")).alias("seq"))
    out = folds.folded(rows, "node", ["seq", "event_id"], ["q", "seq"], folds.cached(3, 2**62), "hit boolean")
    return out.select("event_id", "hit")


def entities(t):
    return t.customer.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("bafk"), F.col("c_custkey").cast("string")).alias("cid"), F.col("c_nationkey").cast("long").alias("space_id"), F.lower("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("properties"), F.lit(None).cast("binary").alias("embedding"), F.lit(0).cast("long").alias("created_at"), F.lit("me").alias("created_by"),
    )


NEW = """n as (select s_suppkey arrival, s_nationkey::bigint space_id, 'concept' entity_type, s_name as "name" from supplier), h as (select max(c_custkey) top from customer where c_custkey % 2 = 0)"""


@query("entity_create", f"""with {NEW} select (top + row_number() over (order by arrival))::bigint id, 'bafk' || substr(sha256('{{"space_id":' || space_id || ',"entity_type":"concept","name":"' || "name" || '","created_by":"me","timestamp":7}}'), 1, 32) cid, space_id, "name" from n, h
    union all select c_custkey, 'bafk' || c_custkey, c_nationkey::bigint, c_name from customer where c_custkey % 2 = 0""")
def _(t):
    new = t.supplier.select(F.col("s_suppkey").alias("arrival"), F.col("s_nationkey").cast("long").alias("space_id"), F.lit("concept").alias("entity_type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("properties"), F.lit("me").alias("created_by"))
    return graph.create_entities(entities(t), new, F.lit(7).cast("long")).select("id", "cid", "space_id", "name")


@query("entity_update_embedding", """with u as (select s_suppkey * 3 id, 'e' || s_suppkey embedding from supplier) select c_custkey id, u.embedding from customer left join u on u.id = c_custkey where c_custkey % 2 = 0""")
def _(t):
    new = t.supplier.select((F.col("s_suppkey") * 3).alias("id"), F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).cast("binary").alias("embedding"))
    return graph.update_embeddings(entities(t), new)[0].select("id", F.col("embedding").cast("string").alias("embedding"))


@query("entity_update_missing", """select s_suppkey * 3 id from supplier where s_suppkey * 3 not in (select c_custkey from customer where c_custkey % 2 = 0)""")
def _(t):
    return graph.update_embeddings(entities(t), t.supplier.select((F.col("s_suppkey") * 3).alias("id"), F.lit(None).cast("binary").alias("embedding")))[1]


@query("entity_delete_by_space", """select count(*) rows_affected from customer where c_custkey % 2 = 0 and c_nationkey = 3""")
def _(t):
    return graph.delete(entities(t), F.col("space_id") == 3)[1]


@query("edge_create", """with h as (select o_orderkey id, o_custkey source_id, o_orderkey target_id from orders where o_orderkey % 2 = 0), n as (select ps_orderkey arrival, l_partkey source_id, l_suppkey target_id from (select l_orderkey * 10 + l_linenumber ps_orderkey, l_partkey, l_suppkey from lineitem group by all))
    select (select max(id) from h) + row_number() over (order by arrival) id, source_id, target_id from (select arrival, min(source_id) source_id, min(target_id) target_id from n group by arrival) union all select id, source_id, target_id from h""")
def _(t):
    text = lambda x: F.lit(x).cast("string")
    held = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), text("bafk0").alias("cid"), F.lit(1).cast("long").alias("space_id"), text("mentions").alias("edge_type"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), text(None).alias("properties"), F.lit(0).cast("long").alias("created_at"), text("me").alias("created_by"))
    new = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival")).agg(F.min("l_partkey").alias("source_id"), F.min("l_suppkey").alias("target_id"))
    new = new.select("arrival", F.lit(1).cast("long").alias("space_id"), text("mentions").alias("edge_type"), "source_id", "target_id", text(None).alias("properties"), text("me").alias("created_by"))
    return graph.create_edges(held, new, F.lit(7).cast("long")).select("id", "source_id", "target_id")


@query("edges_rows_affected", """select count(*) rows_affected from orders where o_custkey = 7 or o_orderkey = 7""")
def _(t):
    return graph.delete(t.orders, (F.col("o_custkey") == 7) | (F.col("o_orderkey") == 7))[1]


def registry(t):
    """Order lines as changes of a registry of parts: returned ones are added, open ones announced, the others removed."""
    action = F.when(F.col("l_returnflag") == "R", "add").when(F.col("l_returnflag") == "N", "announce").otherwise("remove")
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("cid"), action.alias("action"))


REGISTRY = """c as (select l_orderkey * 10 + l_linenumber "at", l_partkey cid, case l_returnflag when 'R' then 'add' when 'N' then 'announce' else 'remove' end action from lineitem),
    h as (select *, coalesce(last_value(case when action <> 'announce' then action end ignore nulls) over (partition by cid order by "at", action rows between unbounded preceding and 1 preceding) = 'add', false) held from c),
    o as (select "at", cid, action, case action when 'add' then if(held, 'present', 'added') when 'remove' then if(held, 'removed', 'absent') else if(held, 'announced', 'unknown') end outcome from h)"""


@query("provider_changes", f"""with {REGISTRY} select "at", cid, action, outcome from o""")
def _(t):
    return stores.provider_outcomes(registry(t)).drop("session")


@query("provider_registry", f"""with {REGISTRY}, l as (select cid, max("at") filter (where outcome = 'added') a, max("at") filter (where outcome = 'removed') r from o group by cid)
    select cid, a first_provided, (select max("at") from o where o.cid = l.cid and outcome = 'announced' and "at" > a) last_announced, (select count(*) from o where o.cid = l.cid and outcome = 'announced' and "at" > a) announcement_count from l where a is not null and (r is null or r < a)""")
def _(t):
    return stores.provided(registry(t))


@query("provider_contains", f"""with {REGISTRY}, l as (select cid, max("at") filter (where outcome = 'added') a, max("at") filter (where outcome = 'removed') r from o group by cid)
    select p_partkey cid, coalesce(a is not null and (r is null or r < a), false) held from part left join l on cid = p_partkey""")
def _(t):
    return stores.contains(stores.provided(registry(t)), t.part.select(F.col("p_partkey").alias("cid")))


@query("vector_upsert", """select 'space-' || label || '-idx' collection, vec_id::varchar cid, 0 chunk_index, case when vec_id % 3 = 0 then 'second' else 'first' end batch, round(embedding[1]::double, 6) lead from embeddings
    union all select 'space-' || label || '-idx', vec_id::varchar, 1, 'second', round(embedding[2]::double, 6) from embeddings where vec_id % 3 = 0""")
def _(t):
    """All vectors as a generation, a third of them, each with one chunk more, as another."""
    from lodestone.sources import files

    path = files.shared(t.spark, "vectors")
    part = lambda rows, i, batch: rows.select(F.concat(F.lit("space-"), F.col("label").cast("string"), F.lit("-idx")).alias("collection"), F.col("vec_id").cast("string").alias("cid"), F.lit(i).alias("chunk_index"), F.lit(batch).alias("batch"), F.get("embedding", F.lit(i)).cast("double").alias("lead"))
    third = t.embeddings.where("vec_id % 3 = 0")
    files.upsert_vectors(part(t.embeddings, 0, "first"), path)
    files.upsert_vectors(part(third, 0, "second").unionByName(part(third, 1, "second")), path)
    return files.vectors(t.spark, path).select("collection", "cid", "chunk_index", "batch", F.round("lead", 6).alias("lead"))
