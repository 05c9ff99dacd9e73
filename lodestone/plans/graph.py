"""Catalog and graph queries: customers are entities, nations their spaces; memberships and orders are edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalogue import query
from lodestone.functions import ids, strings
from lodestone.operators import catalog, graph

ENTITIES = """entities as (select c_custkey id, c_nationkey::bigint space_id, lower(c_mktsegment) entity_type, c_name name, c_acctbal created_at from customer)"""
#: Nodes: customers from 1, nations from 10000000, regions from 20000000.
EDGES = """edges as (select c_custkey id, c_custkey source_id, 10000000 + c_nationkey target_id, 'located_in' edge_type, c_acctbal created_at from customer
  union all select 10000000 + n_nationkey, 10000000 + n_nationkey, 20000000 + n_regionkey, 'part_of', 0 from nation
  union all select 30000000 + c_custkey, c_custkey, c_custkey, 'related_to', c_acctbal from customer where c_custkey % 100 = 7)"""


def entities(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("space_id"), F.lower("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("created_at"))


def edges(t):
    c, n = t.customer, t.nation
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("source_id"), (10000000 + F.col("c_nationkey")).cast("long").alias("target_id"), F.lit("located_in").alias("edge_type"), F.col("c_acctbal").alias("created_at"))
    b = n.select((10000000 + F.col("n_nationkey")).cast("long").alias("id"), (10000000 + F.col("n_nationkey")).cast("long").alias("source_id"), (20000000 + F.col("n_regionkey")).cast("long").alias("target_id"), F.lit("part_of").alias("edge_type"), F.lit(0.0).alias("created_at"))
    d = c.where("c_custkey % 100 = 7").select((30000000 + F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("target_id"), F.lit("related_to").alias("edge_type"), F.col("c_acctbal").alias("created_at"))
    return a.unionByName(b).unionByName(d)


@query("entity_list_paged", f"""with {ENTITIES} select id, name, entity_type from entities where space_id = 3 and entity_type = 'building' and contains(name, '1') order by created_at desc, id limit 5 offset 1""")
def _(t):
    return graph.entity_list(entities(t), 3, "building", "1", 1, 5).select("id", "name", "entity_type")


@query("entity_find_by_name", f"""with {ENTITIES} select id, space_id, name from entities where space_id = (select space_id from entities where id = 11) and name = (select name from entities where id = 11) order by id limit 1""")
def _(t):
    one = entities(t).where("id = 11").first()
    return graph.find_by_name(entities(t), one.space_id, one.name).select("id", "space_id", "name")


@query("entity_get", f"""with {ENTITIES} select id, name from entities where id = 42""")
def _(t):
    return graph.get(entities(t), "id", 42).select("id", "name")


@query("edges_for_entity", f"""with {EDGES} select id::bigint id, edge_type from edges where source_id = 107 union all select id::bigint, edge_type from edges where target_id = 107""")
def _(t):
    return graph.edges_for(edges(t), 107, "both").select("id", "edge_type")


@query("edge_list", f"""with {EDGES} select id::bigint id, edge_type from edges where edge_type = 'located_in' order by created_at desc, id limit 20 offset 5""")
def _(t):
    return graph.edge_list(edges(t), "located_in", 5, 20).select("id", "edge_type")


@query("find_edge", f"""with {EDGES} select id::bigint id, edge_type from edges where source_id = 107 and target_id = 107 and edge_type = 'related_to'""")
def _(t):
    return graph.find_edge(edges(t), 107, 107, "related_to").select("id", "edge_type")


@query("edges_delete_by_entity", f"""with {EDGES} select edge_type, count(*) n from edges where source_id <> 107 and target_id <> 107 group by 1""")
def _(t):
    return graph.delete_by_entity(edges(t), 107).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("counts_by_space", f"""with {ENTITIES} select space_id, count(*) n from entities group by 1""")
def _(t):
    return graph.counts_by_space(entities(t))


@query("counts_edges_by_space", """select c_nationkey::bigint space_id, count(*) n from orders join customer on o_custkey = c_custkey group by 1""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("space_id"))
    return graph.counts_by_space(rows)


@query("edge_pseudo_cid", """select o_orderkey, 'bafk' || substr(sha256('{"space_id":1,"edge_type":"mentions","source_id":' || o_custkey || ',"target_id":' || o_orderkey || '}'), 1, 32) cid from orders""")
def _(t):
    body = F.to_json(F.struct(F.lit(1).alias("space_id"), F.lit("mentions").alias("edge_type"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id")))
    return t.orders.select("o_orderkey", ids.pseudo_cid(body).alias("cid"))


@query("backfill_space_names", """select n_nationkey id, case when n_nationkey % 3 = 0 then n_name else rtrim(regexp_extract('/data/' || n_name || '/', '([^/]+)/*$', 1)) end "name" from nation""")
def _(t):
    held = t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("name"), F.concat(F.lit("/data/"), "n_name", F.lit("/")).alias("location"), F.sha2("n_name", 256).alias("key"))
    return catalog.backfill_names(held).select("id", "name")


@query("graph_traverse_2hop", f"""with {EDGES}, h as (select distinct source_id, target_id from edges),
    one as (select h.source_id start, h.target_id id, 1 depth from h where h.source_id <> h.target_id and h.source_id < 10000000),
    two as (select one.start, h.target_id id, 2 depth from one join h on h.source_id = one.id where h.target_id <> one.start)
    select start::bigint start, id::bigint id, min(depth)::int depth from (select * from one union all select * from two) group by start, id""")
def _(t):
    return graph.traverse(edges(t), t.customer.select(F.col("c_custkey").alias("start")), 2).select("start", "id", "depth")


@query("graph_traverse_typed", f"""with {EDGES} select source_id::bigint start, target_id::bigint id, 1 depth, source_id || '>' || target_id path from edges where edge_type = 'part_of'""")
def _(t):
    found = graph.traverse(edges(t), t.nation.select((10000000 + F.col("n_nationkey")).cast("long").alias("start")), 2, "part_of")
    return found.select("start", "id", "depth", F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


@query("entity_with_edges", f"""with {EDGES}, {ENTITIES}, b as (select id edge_id, edge_type, target_id other_id, 'outgoing' direction from edges where source_id = 107
    union all select id, edge_type, source_id, 'incoming' from edges where target_id = 107)
    select edge_id::bigint edge_id, edge_type, other_id::bigint other_id, direction, name other_name from b join entities on other_id = entities.id""")
def _(t):
    return graph.with_edges(107, edges(t), entities(t)).select("edge_id", "edge_type", "other_id", "direction", "other_name")


@query("space_status_left_join", """select n_nationkey::bigint id, n_name name, coalesce(r.open, false) indexing_in_progress, coalesce(r.files, 0)::bigint files_indexed, coalesce(r.chunks, 0)::bigint chunks_stored, 0::bigint files_failed
    from nation left join (select s_nationkey, true open, count(*) files, sum(s_suppkey) chunks from supplier group by 1) r on n_nationkey = s_nationkey""")
def _(t):
    spaces = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    status = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("space_id")).agg(F.lit(True).alias("indexing_in_progress"), F.count(F.lit(1)).alias("files_indexed"), F.sum("s_suppkey").alias("chunks_stored"), F.lit(0).cast("long").alias("files_failed"))
    return catalog.space_status(spaces, status)


@query("space_entities_join", """select c_custkey id, c_name name from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation)""")
def _(t):
    first = t.nation.agg(F.min("n_name")).first()[0]
    spaces = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("key"))
    return catalog.space_entities(first, spaces, entities(t)).select("id", "name")


@query("space_delete_cascade", f"""with {ENTITIES} select 'spaces' kind, count(*) n from nation where n_nationkey <> 3 union all select 'entities', count(*) from entities where space_id <> 3""")
def _(t):
    spaces, left = catalog.delete_space(3, t.nation.select(F.col("n_nationkey").alias("id")), entities(t))
    count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(spaces, "spaces").unionByName(count(left, "entities"))


@query("space_create", """select distinct sha256('/data/' || source) "key", source name, '/data/' || source location from documents where source <> 'src3'""")
def _(t):
    held = t.spark.sql("select sha2('/data/src3', 256) key, 'elsewhere' name")
    return catalog.create_spaces(t.documents.select(F.concat(F.lit("/data/"), "source").alias("location")), held)


@query("space_key_name", """select page_id, sha256(url) space_key, case when length(trim(regexp_extract(rtrim(url, '/'), '[^/]*$'))) > 0 then trim(regexp_extract(rtrim(url, '/'), '[^/]*$')) else substr(sha256(url), 1, 8) end "name" from pages""")
def _(t):
    key = ids.space_key(F.col("url"))
    return t.pages.select("page_id", key.alias("space_key"), strings.derive_name(F.col("url"), key).alias("name"))


@query("entity_pseudo_cid", """select c_custkey, 'bafk' || substr(sha256('{"name":"' || c_name || '"}'), 1, 32) cid from customer""")
def _(t):
    return t.customer.select("c_custkey", ids.pseudo_cid(F.to_json(F.struct(F.col("c_name").alias("name")))).alias("cid"))


@query("enum_parse", """select c_mktsegment, case when lower(c_mktsegment) in ('building', 'machinery') then lower(c_mktsegment) end entity_type, count(*) n from customer group by 1, 2""")
def _(t):
    return t.customer.groupBy("c_mktsegment", strings.parse_enum(F.col("c_mktsegment"), ["building", "machinery"]).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@query("user_get_or_create", """with held as (select c_custkey id, 'did:key:' || c_custkey did from customer where c_custkey <= 100), want as (select distinct 'did:key:' || o_custkey did from orders)
    select did, 'held' state from held union all select did, 'new' from want where did not in (select did from held)""")
def _(t):
    held = t.customer.where("c_custkey <= 100").select(F.concat(F.lit("did:key:"), F.col("c_custkey").cast("string")).alias("did"), F.lit("held").alias("state"))
    want = t.orders.select(F.concat(F.lit("did:key:"), F.col("o_custkey").cast("string")).alias("did"), F.lit("new").alias("state"))
    return graph.insert_if_absent(held, want, "did", ["did"])


@query("kv_scan", """select user_id, arg_max(value, event_id) value from events group by user_id having arg_max(event_type, event_id) <> 'error'""")
def _(t):
    return graph.last_write(t.events, "user_id", F.col("event_id"), F.col("event_type") == "error").select("user_id", "value")


@query("index_status_upsert", """with held as (select n_nationkey::bigint space_id, 5 last_indexed, 7::bigint files_indexed, 'old' last_error from nation), runs as (select s_nationkey::bigint space_id, max(s_suppkey) % 2 = 0 ok, count(*) files from supplier group by 1)
    select h.space_id, case when ok then 9 else last_indexed end last_indexed, case when ok then files else files_indexed end files_indexed, case when ok then null when ok is not null then 'failed' else last_error end last_error from held h left join runs using (space_id)""")
def _(t):
    held = t.nation.select(F.col("n_nationkey").cast("long").alias("space_id"), F.lit(5).alias("last_indexed"), F.lit(True).alias("indexing_in_progress"), F.lit(7).cast("long").alias("files_indexed"), F.lit(0).cast("long").alias("files_failed"), F.lit("old").alias("last_error"))
    runs = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("space_id")).agg((F.max("s_suppkey") % 2 == 0).alias("ok"), F.count(F.lit(1)).alias("files"), F.lit(9).alias("at"), F.lit(0).cast("long").alias("failed"), F.lit("failed").alias("error"))
    return catalog.upsert_status(held, runs).select("space_id", "last_indexed", "files_indexed", "last_error")


STAR = "from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def star(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))


def revenue():
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return F.round(F.sum(cents) / 100.0, 2).alias("revenue")


REVENUE_SQL = "round(sum(round(l_extendedprice * (1 - l_discount) * 100)::bigint) / 100.0, 2)::double"


@query("sql_star_join", f"""select r_name, o_orderpriority, count(*) n, {REVENUE_SQL} revenue {STAR} group by 1, 2""")
def _(t):
    return star(t).groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), revenue())


@query("sql_cube", f"""select r_name, l_returnflag, count(*) n {STAR} group by cube (r_name, l_returnflag)""")
def _(t):
    return star(t).cube("r_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("sql_rollup", f"""select r_name, n_name, count(*) n, {REVENUE_SQL} revenue {STAR} group by rollup (r_name, n_name)""")
def _(t):
    return star(t).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), revenue())


@query("sql_rank", """select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::bigint place from orders qualify place <= 3""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("place", F.rank().over(w).cast("long")).where("place <= 3").select("o_custkey", "o_orderkey", "place")
