"""Content queries: documents are files, their sources spaces or publishers; chunks, blocks, manifests, indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalogue import query
from lodestone.functions import chunking, ids, scopes, strings
from lodestone.operators import blocks, catalog, graph, indexing, mentions, publish

CHUNKS = """chunks as (select doc_id, i idx, i * 1000 "offset", substr(text, i * 1000 + 1, 1000) chunk from (select doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) i from documents where length(text) > 0))"""


def chunks(t):
    return chunking.fixed(t.documents, 1000)


def cids(t):
    return t.documents.select("doc_id", ids.cid_hex(F.col("text").cast("binary")).alias("cid"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("arrival"), "source", "lang")


CIDS = """cids as (select doc_id, '01551220' || sha256(text) cid, strlen(text) size, doc_id arrival, source, lang from documents)"""


@query("content_id_hex", f"""with {CIDS} select doc_id, cid, size from cids""")
def _(t):
    return cids(t).select("doc_id", "cid", "size")


@query("content_id_text", """with c as (select doc_id, '01551220' || sha256(text) h from documents), b as (select doc_id, h, unhex(h) raw from c),
    k as (select doc_id, 'b' || array_to_string(list_transform(range(0, 58), lambda i: 'abcdefghijklmnopqrstuvwxyz234567'[1 + ((('0x' || substr(h || '0000', 2 * ((i * 5) // 8) + 1, 4))::bigint >> (11 - (i * 5) % 8)) & 31)]), '') cid from b)
    select doc_id, cid, 85 codec, true verified from k""")
def _(t):
    raw = t.documents.select("doc_id", ids.cid_bytes(F.col("text").cast("binary")).alias("raw"), "text").withColumn("cid", ids.cid_text("raw"))
    return raw.select("doc_id", "cid", ids.cid_codec(ids.cid_parse("cid")).alias("codec"), ids.cid_verifies(ids.cid_parse("cid"), F.col("text").cast("binary")).alias("verified"))


@query("content_id_parts", """select doc_id, 85 codec, sha256(text) digest, true verified from documents""")
def _(t):
    raw = ids.cid_bytes(F.col("text").cast("binary"))
    return t.documents.select("doc_id", ids.cid_codec(raw).alias("codec"), ids.cid_digest(raw).alias("digest"), ids.cid_verifies(raw, F.col("text").cast("binary")).alias("verified"))


@query("is_binary", """select doc_id, case when contains(text, chr(0)) then true when length(text) = 0 then false else length(regexp_replace(text, '[!-~\\s\\x{85}\\x{a0}]', '', 'g'))::double / length(text) > 0.3 end is_binary from documents""")
def _(t):
    return t.documents.select("doc_id", strings.is_binary(F.col("text")).alias("is_binary"))


@query("is_indexable", """select lang, count(*) n, ('text/' || lang) like 'text/%' a, ('image/' || lang) like 'text/%' b, false c from documents group by lang""")
def _(t):
    text, image, pdf = F.concat(F.lit("text/"), "lang"), F.concat(F.lit("image/"), "lang"), F.lit("application/pdf")
    out = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return out.select("lang", "n", strings.indexable(text, F.lit(10)).alias("a"), strings.indexable(image, rule="remote").alias("b"), strings.indexable(pdf, rule="published").alias("c"))


KINDS = ["rs", "py", "js", "tsx", "java", "go", "rb", "cs", "h", "hxx", "exs", "htm", "php", "sol", "MD", "mdx", "zzz"]


@query("detect_language", f"""with p as (select page_id, url || '.' || {KINDS}[page_id % {len(KINDS)} + 1] path, {KINDS}[page_id % {len(KINDS)} + 1] ext from pages)
    select page_id, case ext when 'rs' then 'rust' when 'py' then 'python' when 'js' then 'javascript' when 'tsx' then 'typescript' when 'java' then 'java' when 'go' then 'go' when 'rb' then 'ruby' when 'cs' then 'csharp' when 'h' then 'c' when 'hxx' then 'cpp' when 'exs' then 'elixir'
      when 'htm' then 'html' when 'php' then 'php' when 'sol' then 'solidity' end "language", ext in ('MD', 'mdx') markdown from p where not ends_with(path, '/.' || ext)""")
def _(t):
    """Every page's address with an extension of each kind in turn."""
    ext = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % len(KINDS) + 1).cast("int"))
    p = t.pages.select("page_id", F.concat("url", F.lit("."), ext).alias("path"), ext.alias("ext")).where(~F.endswith("path", F.concat(F.lit("/."), "ext")))
    return p.select("page_id", strings.detect_language(F.col("path")).alias("language"), strings.is_markdown(F.col("path")).alias("markdown"))


@query("file_validate_reasons", """select doc_id, case when strlen(text) > 15000 then 'too_large' when contains(text, chr(0)) or length(regexp_replace(text, '[!-~\\s\\x{85}\\x{a0}]', '', 'g'))::double / greatest(length(text), 1) > 0.3 then 'binary'
    when contains('/' || source || '/', '/src3/') then 'excluded' when strlen(trim(text)) < 300 then 'too_small' end skip_reason from documents""")
def _(t):
    path = F.concat(F.lit("/"), "source", F.lit("/"))
    return t.documents.select("doc_id", indexing.skip_reason(path, F.col("text"), F.octet_length("text"), 15000, ["/src3/"], 300).alias("skip_reason"))


METRICS = """m as (select source, count(*) filter (where quality = 1) loaded, count(*) filter (where quality is null) skipped, count(*) filter (where quality = 0) failed, sum(n_chars // 1000)::bigint chunks
    from documents left join labels using (doc_id) group by source)"""


def runs(t):
    status = F.when(F.col("quality") == 1, "loaded").when(F.col("quality") == 0, "failed").otherwise("skipped")
    return t.documents.join(t.labels, "doc_id", "left").select("source", status.alias("status"), F.expr("n_chars div 1000").alias("chunks"))


@query("pipeline_metrics", f"""with {METRICS} select *, round(case when loaded + failed = 0 then 0 else failed::double / (loaded + failed) end, 6) failure_rate from m""")
def _(t):
    return indexing.metrics(runs(t), "source").withColumn("failure_rate", F.round("failure_rate", 6))


@query("failure_threshold", f"""with {METRICS}, r as (select *, case when loaded + failed = 0 then 0 else failed::double / (loaded + failed) end rate from m)
    select source, case when loaded + failed < 15 then 'insufficient_data' when rate > 0.3 then 'catastrophic' when rate > 0.2 then 'critical' when rate > 0.1 then 'warning' else 'ok' end status,
    case when loaded + failed < 15 then null when rate > 0.2 then 'failure_rate' when loaded = 0 and failed > 0 then 'zero_success' end error from r""")
def _(t):
    m = indexing.metrics(runs(t), "source")
    total = F.col("loaded") + F.col("failed")
    return m.select("source", indexing.threshold_status(F.col("failure_rate"), total, 0.2, 15).alias("status"), indexing.final_error(F.col("loaded"), F.col("failed"), 0.2, 15).alias("error"))


@query("incremental_anti", """select doc_id from documents where sha256(text) not in (select sha256(d.text) from documents d join labels using (doc_id))""")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return indexing.unindexed(d, d.join(t.labels, "doc_id", "left_semi")).select("doc_id")


@query("missing_cids", f"""with {CIDS} select distinct cid from cids where cid not in (select cid from cids join labels using (doc_id))""")
def _(t):
    c = cids(t)
    return c.select("cid").distinct().join(c.join(t.labels, "doc_id", "left_semi"), "cid", "left_anti")


@query("already_exists_semi", f"""with {CIDS} select doc_id from cids where cid in (select cid from cids join labels using (doc_id))""")
def _(t):
    c = cids(t)
    return c.join(c.join(t.labels, "doc_id", "left_semi"), "cid", "left_semi").select("doc_id")


@query("common_cids", f"""with {CHUNKS} select sha256(chunk) cid from chunks where doc_id % 2 = 0 intersect select sha256(chunk) from chunks where doc_id % 2 = 1""")
def _(t):
    c = chunks(t).select("doc_id", F.sha2("chunk", 256).alias("cid"))
    return c.where("doc_id % 2 = 0").select("cid").intersect(c.where("doc_id % 2 = 1").select("cid"))


@query("content_resolve", """with w as (select 'd' || doc_id cid from documents union select 'd' || item_id from benchmark union select 'x' || doc_id from documents)
    select w.cid, case when d.doc_id is not null then 'local' when b.item_id is not null then 'remote' else 'not_found' end origin, case when d.doc_id is not null then d.source when b.item_id is not null then 'item' end title,
    coalesce(d.n_chars, length(b.text)) size from w left join (select * from documents join labels using (doc_id)) d on 'd' || d.doc_id = cid left join benchmark b on 'd' || b.item_id = cid""")
def _(t):
    """Labelled documents are published here, benchmark items elsewhere; every id of both is asked for, and as many that nobody has."""
    name = lambda c, p="d": F.concat(F.lit(p), F.col(c).cast("string")).alias("cid")
    published = t.documents.join(t.labels, "doc_id", "left_semi").select(name("doc_id"), F.col("source").alias("title"), F.col("n_chars").alias("size"))
    remote = t.benchmark.select(name("item_id"), F.lit("item").alias("title"), F.length("text").cast("long").alias("size"))
    wanted = t.documents.select(name("doc_id")).union(t.benchmark.select(name("item_id"))).union(t.documents.select(name("doc_id", "x"))).distinct()
    return catalog.resolve(wanted, published, remote)


@query("content_providers", """select distinct 'd' || doc_id cid, 'me' provider from documents union select distinct 'd' || item_id, 'peer' || (item_id % 3) from benchmark""")
def _(t):
    published = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("cid"))
    remote = t.benchmark.select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("cid"), F.concat(F.lit("peer"), (F.col("item_id") % 3).cast("string")).alias("publisher"))
    return catalog.providers(published, remote, "me")


@query("publish_simple", f"""with {CIDS}, held as (select distinct cid, size, 'held' title from cids join labels using (doc_id)), r as (select *, row_number() over w n, first_value(lang) over w first from cids window w as (partition by cid order by arrival))
    select r.arrival doc_id, r.cid, r.size, 1::bigint block_count, case when h.cid is not null then h.title else r.first end title, h.cid is not null or n > 1 already_published from r left join held h using (cid)""")
def _(t):
    c = cids(t)
    held = c.join(t.labels, "doc_id", "left_semi").select("cid", "size", F.lit(1).cast("long").alias("block_count"), F.lit("held").alias("title")).distinct()
    new = t.documents.select(F.col("doc_id").alias("arrival"), F.col("text").cast("binary").alias("data"), F.col("lang").alias("title"))
    return publish.publish(held, new).withColumnRenamed("arrival", "doc_id")


#: Trees of fanout 3 over documents of more than two chunks, level by level up to six of them: 2,187 chunks.
def tree_sql(fanout: int = 3, flat: int = 2, most: int = 6) -> str:
    """Common table expressions l0 to l6 (doc_id, pos, cid, n): each level's nodes, and how many a level has."""
    out = [f"l0 as (select doc_id, idx pos, '01551220' || sha256(chunk) cid, length(chunk) size, count(*) over (partition by doc_id) n, count(*) over (partition by doc_id) total from chunks)"]
    for k in range(1, most + 1):
        out.append(f"""g{k} as (select doc_id, pos // {fanout} pos, string_agg(cid, ',' order by pos) links, total from l{k - 1} where n > {fanout} and total > {flat} group by doc_id, pos // {fanout}, total),
    l{k} as (select doc_id, pos, '01711220' || sha256(links) cid, strlen(links) size, count(*) over (partition by doc_id) n, total from g{k})""")
    every = " union all ".join(f"select {k} level, doc_id, pos, cid, size::bigint size, n, total from l{k}" for k in range(most + 1))
    return ",\n    ".join([*out, f"nodes as ({every}), top as (select doc_id, max(level) depth from nodes group by doc_id)"])


MADE = f"""{tree_sql()}, kids as (select doc_id, '["' || string_agg(cid, '","' order by pos) || '"]' children from nodes join top using (doc_id) where level = depth group by doc_id),
    m as (select d.doc_id, d.source, d.lang, coalesce(k.children, '[]') children, coalesce(c.n, 0) n, coalesce(c.s, 0)::bigint s, case when c.n > 2 then 'tree' else 'flat' end structure, coalesce(case when c.n > 2 then t.depth end, 0) depth
      from documents d left join kids k using (doc_id) left join top t using (doc_id) left join (select doc_id, count(*) n, sum(length(chunk)) s from chunks group by doc_id) c using (doc_id)),
    made as (select *, '{{"children":' || children || ',"chunk_count":' || n || ',"content_type":"text/plain","depth":' || depth || ',"name":"' || source || '","publisher":"did:me","structure":"' || structure || '","total_size":' || s || '}}' body from m)"""


def dag(t, **switches):
    c = chunks(t).select("doc_id", "idx", "size", ids.cid_hex(F.col("chunk").cast("binary")).alias("cid"))
    meta = t.documents.select("doc_id", F.col("source").alias("name"), F.lit("text/plain").alias("content_type"), F.lit("did:me").alias("publisher"))
    return publish.publish_dag(c, meta, 2, 3, **switches)


@query("publish_dag", f"""with {CHUNKS}, {MADE} select doc_id, '01711220' || sha256(body) root_cid, n chunk_count, s total_size, structure, depth::int depth, 'success' dht, 'skipped' gossip from made""")
def _(t):
    return dag(t, gossip=False)[0].select("doc_id", "root_cid", "chunk_count", "total_size", "structure", "depth", "dht", "gossip")


@query("publish_blocks", f"""with {CHUNKS}, {MADE}, b as (select cid, case when level = 0 then size else size end size from nodes where level = 0 or (total > 2) union select '01711220' || sha256(body), strlen(body) from made) select cid, min(size)::bigint size from b group by cid""")
def _(t):
    return dag(t)[1]


@query("publish_announced", f"""with {CHUNKS}, {MADE}, a as (select doc_id, cid from nodes join top using (doc_id) where level = depth union select doc_id, '01711220' || sha256(body) from made) select doc_id, count(*) n from a group by doc_id""")
def _(t):
    return dag(t)[2].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("content_info", f"""with {CHUNKS}, {MADE}, r as (select distinct '01711220' || sha256(body) cid, s, n from made) select cid, 'ok' status, s total_size, n chunk_count, true is_local from r
    union all select distinct '01551220' || sha256(text), 'not_found', null, null, false from documents union all select distinct source, 'invalid_cid', null, null, false from documents""")
def _(t):
    made, stored, _ = dag(t)
    wanted = made.select(F.col("root_cid").alias("cid")).union(t.documents.select(ids.cid_hex(F.col("text").cast("binary")))).union(t.documents.select("source")).distinct()
    stored = stored.join(t.documents.select(ids.cid_hex(F.col("text").cast("binary")).alias("cid")), "cid", "left_anti")
    return publish.info(wanted, made, stored)


@query("content_list_local", f"""with {CHUNKS}, {MADE} select distinct '01711220' || sha256(body) cid from made""")
def _(t):
    made, stored, _ = dag(t)
    return made.select(F.col("root_cid").alias("cid")).distinct().join(stored, "cid", "left_semi")


@query("fetch_retry", """with a as (select l_orderkey cid, row_number() over (partition by l_orderkey order by l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000) n, case when l_returnflag = 'N' then 'ok' when l_linestatus = 'F' and l_returnflag = 'A' then 'not_found' else 'failed' end o from lineitem),
    e as (select cid, min(n) filter (where o <> 'failed') f, max(n) l from a where n <= 3 group by cid) select e.cid, a.o status, a.n tries from e join a on a.cid = e.cid and a.n = coalesce(f, l)""")
def _(t):
    outcome = F.when(F.col("l_returnflag") == "N", "ok").when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), "not_found").otherwise("failed")
    return publish.retried(t.lineitem.select(F.col("l_orderkey").alias("cid"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("attempt"), outcome.alias("outcome")), 2)


@query("published_list", """select doc_id cid, 10::bigint page_count, (select count(*) from documents) total from documents order by n_chars desc, doc_id limit 10 offset 20""")
def _(t):
    return catalog.listing(t.documents.select(F.col("doc_id").alias("cid"), "n_chars"), "n_chars", 20, 10).select("cid", "page_count", "total")


@query("remote_status", """select doc_id, case when doc_id % 3 = 0 then true when doc_id % 3 = 1 then false else true end indexed, case when doc_id % 3 = 1 then 'failed' when doc_id % 3 = 2 then 'old' end index_error from documents""")
def _(t):
    rows = t.documents.select("doc_id", F.lit(True).alias("indexed"), F.lit("old").alias("index_error"), F.lit(0).alias("indexed_at"))
    outcome = F.when(F.col("doc_id") % 3 == 0, "ok").when(F.col("doc_id") % 3 == 1, "error")
    return catalog.remote_status(rows, outcome, F.lit(1)).select("doc_id", "indexed", "index_error")


@query("block_dedup_put", f"""with {CIDS}, r as (select *, row_number() over (partition by cid order by arrival) n from cids)
    select doc_id, case when size > 10000 then 'too_large' when n > 1 or cid in (select cid from cids where doc_id % 7 = 0) then 'duplicate' else 'stored' end outcome from r""")
def _(t):
    c = cids(t)
    return blocks.put(c.where("doc_id % 7 = 0").select("cid").distinct(), c, 10000).select(F.col("arrival").alias("doc_id"), "outcome")


@query("block_stats", f"""with {CIDS} select count(*) block_count, sum(size)::bigint total_size_bytes from (select distinct cid, size from cids)""")
def _(t):
    return blocks.stats(cids(t).select("cid", "size").distinct())


@query("block_capacity", f"""with {CIDS}, r as (select *, row_number() over (partition by cid order by arrival) n from cids), f as (select *, sum(size) over (order by arrival) total from r where n = 1 and size <= 10000)
    select r.doc_id, case when r.size > 10000 then 'too_large' when r.n > 1 then 'duplicate' when f.total > 300000 then 'full' else 'stored' end outcome from r left join f on f.arrival = r.arrival""")
def _(t):
    c = cids(t)
    return blocks.put(c.select("cid").where("false"), c, 10000, 300000).select(F.col("arrival").alias("doc_id"), "outcome")


def pin_changes(t):
    """Unlabelled documents are pinned, then every third one is unpinned; blocks are those of even ids."""
    c = cids(t)
    a = F.when(F.col("doc_id") % 3 == 0, "unpin").otherwise("pin")
    return blocks.pinned(c.where("doc_id % 2 = 0").select("cid"), c.where("doc_id % 5 = 0").select("cid"), c.select(F.col("doc_id").alias("at"), "cid", a.alias("action")))


PINS = f"""{CIDS}, c as (select doc_id "at", cid, case when doc_id % 3 = 0 then 'unpin' else 'pin' end action, cid in (select cid from cids where doc_id % 2 = 0) b, cid in (select cid from cids where doc_id % 5 = 0) p from cids),
    s as (select *, action = 'unpin' or b is_real, last_value(case when action = 'unpin' or b then action = 'pin' end ignore nulls) over (partition by cid order by "at" rows between unbounded preceding and 1 preceding) was from c),
    o as (select *, case when not is_real then 'not_found' when action = 'unpin' and not coalesce(was, p) then 'not_pinned' else 'ok' end outcome from s)"""


@query("pin_outcomes", f"""with {PINS} select "at", cid, action, outcome from o""")
def _(t):
    return pin_changes(t)[1]


@query("pinned_after", f"""with {PINS}, l as (select cid, arg_max(action, "at") a from o where outcome = 'ok' group by cid) select distinct cid from cids where cid in (select cid from l where a = 'pin') or (doc_id % 5 = 0 and cid not in (select cid from l))""")
def _(t):
    return pin_changes(t)[0]


@query("block_get_batch", f"""with {CIDS}, w as (select distinct cid, size from cids where doc_id % 2 = 0) select r.doc_id pos, r.cid, w.cid is not null found, w.size from (select * from cids where doc_id % 5 = 0) r left join w using (cid)""")
def _(t):
    c = cids(t)
    return blocks.get_batch(c.where("doc_id % 5 = 0").select(F.col("doc_id").alias("pos"), "cid"), c.where("doc_id % 2 = 0").select("cid", "size").distinct())


@query("block_delete_unpinned", f"""with {CIDS} select distinct cid from cids where cid not in (select cid from cids where doc_id % 3 = 0 and cid not in (select cid from cids where doc_id % 2 = 0))""")
def _(t):
    c = cids(t)
    return blocks.delete_unpinned(c.select("cid").distinct(), c.where("doc_id % 3 = 0").select("cid"), c.where("doc_id % 2 = 0").select("cid"))


@query("block_verify", f"""with {CIDS} select count(*) good from cids""")
def _(t):
    d = t.documents.withColumn("cid", ids.cid_hex(F.col("text").cast("binary")))
    return blocks.verified(d, F.col("cid"), F.col("text").cast("binary")).agg(F.count(F.lit(1)).alias("good"))


@query("content_server", f"""with {CIDS}, q as (select cid, case doc_id % 3 when 0 then 'block' when 1 then 'manifest' else 'odd' end kind from cids)
    select cid, kind, case when kind = 'block' then 'block' when kind = 'manifest' then case when cid in (select cid from cids where doc_id % 4 = 0) then 'manifest' else 'not_found' end else 'error' end status from q""")
def _(t):
    c = cids(t)
    kind = F.when(F.col("doc_id") % 3 == 0, "block").when(F.col("doc_id") % 3 == 1, "manifest").otherwise("odd")
    return blocks.answer(c.select("cid", kind.alias("kind")), c.select("cid").distinct(), c.where("doc_id % 4 = 0").select("cid").distinct())


@query("chunk_fixed", f"""with {CHUNKS} select doc_id, idx, "offset", length(chunk) size, sha256(chunk) digest from chunks""")
def _(t):
    return chunks(t).select("doc_id", "idx", "offset", "size", F.sha2("chunk", 256).alias("digest"))


def _cdc(t, kind):
    data = t.documents.select("doc_id", F.col("text").cast("binary").alias("data"))
    return chunking.content_defined(data, kind, chunking.SMALL).select("doc_id", "idx", "offset", "size", "cid")


@query("chunk_rabin")
def _(t):
    return _cdc(t, "rabin")


@query("chunk_fastcdc")
def _(t):
    return _cdc(t, "fastcdc")


@query("chunk_paragraphs", """with recursive p as (select conv_id, row_number() over (partition by conv_id order by turn) n, trim(text, ' ' || chr(9) || chr(10) || chr(13)) part from conversations where length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0),
    s as (select conv_id, n, case when strlen(part) >= 600 then null else part end pack, case when strlen(part) >= 600 then [part] else []::varchar[] end done from p where n = 1
      union all select p.conv_id, p.n,
        case when s.pack is null or strlen(s.pack) + strlen(p.part) + 2 > 600 then case when strlen(p.part) >= 600 then null else p.part end when strlen(s.pack) + strlen(p.part) + 2 >= 600 then null else s.pack || chr(10) || chr(10) || p.part end,
        list_concat(s.done, case when s.pack is null then case when strlen(p.part) >= 600 then [p.part] else []::varchar[] end
          when strlen(s.pack) + strlen(p.part) + 2 > 600 then list_concat(case when strlen(s.pack) >= 100 then [s.pack] else []::varchar[] end, case when strlen(p.part) >= 600 then [p.part] else []::varchar[] end)
          when strlen(s.pack) + strlen(p.part) + 2 >= 600 then [s.pack || chr(10) || chr(10) || p.part] else []::varchar[] end)
      from s join p on p.conv_id = s.conv_id and p.n = s.n + 1),
    e as (select conv_id, arg_max(list_concat(done, case when pack is not null and strlen(pack) >= 100 then [pack] else []::varchar[] end), n) l from s group by conv_id)
    select conv_id doc_id, i - 1 idx, l[i] chunk from (select conv_id, l, unnest(range(1, len(l) + 1)) i from e)""")
def _(t):
    """Conversations as texts, their turns parted by blank lines."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    texts = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(turns, "\n\n").alias("text"))
    return chunking.packed(texts, 100, 600)


@query("chunk_smart")
def _(t):
    """By kind of file: pages as HTML, documents as Markdown, a third of them, or code, or text."""
    page = chunking.packed(t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), 50, 2000, extension="html")
    kinds = ["md", "py", "txt"]
    rest = [chunking.packed(t.documents.where(F.col("doc_id") % 3 == i).select("doc_id", "text"), 50, 2000, extension=k).withColumn("kind", F.lit(k)) for i, k in enumerate(kinds)]
    out = page.withColumn("kind", F.lit("html"))
    for r in rest:
        out = out.unionByName(r)
    return out


@query("chunk_scopes", """select doc_id, sha256(text) digest, strlen(text) size, true fits from documents where length(text) > 0""")
def _(t):
    """Whole texts as code, Markdown and prose: what their chunks are together, and whether each keeps to the limit."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("py", "rs", "md", "txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    parts = scopes.scoped(t.documents.select("doc_id", kind.alias("extension"), "text"), 2000)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk"))), lambda c: c["chunk"]), "")
    return parts.groupBy("doc_id").agg(F.sha2(whole, 256).alias("digest"), F.sum(F.octet_length("chunk")).alias("size"), (F.max(F.octet_length("chunk")) <= 2000).alias("fits"))


@query("dedup_effectiveness")
def _(t):
    c = _cdc(t, "rabin")
    return c.groupBy("cid").agg(F.count_distinct("doc_id").alias("n")).agg(F.count(F.lit(1)).alias("distinct_chunks"), F.count_if(F.col("n") > 1).alias("shared_chunks"))


@query("dedup_two_chunkings", """with s as (select doc_id, unnest(range(0, length(text), 1000)) o, text from documents where length(text) > 0), a as (select distinct sha256(substr(text, o + 1, 1000)) c from s),
    b as (select distinct sha256(substr(t, o + 1, 1000)) c from (select 'x' || text t, unnest(range(0, length(text) + 1, 1000)) o from documents where length(text) > 0))
    select (select count(*) from a) first_chunks, (select count(*) from b) second_chunks, (select count(*) from (select c from a intersect select c from b)) common_chunks""")
def _(t):
    """Fixed chunks of texts, and of the same texts after one letter came before them: what one insertion leaves of such a chunking."""
    d = t.documents.select("doc_id", "text")
    one, two = chunking.fixed(d, 1000), chunking.fixed(d.where(F.length("text") > 0).withColumn("text", F.concat(F.lit("x"), "text")), 1000)
    return chunking.effectiveness(one.select(F.sha2("chunk", 256).alias("cid")), two.select(F.sha2("chunk", 256).alias("cid")))


@query("dedup_after_insertion")
def _(t):
    """The same by content: chunks that gear hashing cuts fall into step again."""
    d = t.documents.select("doc_id", F.col("text").cast("binary").alias("data"))
    moved = d.withColumn("data", F.concat(F.lit("x").cast("binary"), "data"))
    return chunking.effectiveness(*(chunking.content_defined(x, "fastcdc", chunking.SMALL).select("cid") for x in (d, moved)))


WHOLE = "select doc_id, sha256(text) digest, strlen(text) size, true fits from documents where length(text) > 0"


def whole_chunks(t, kind):
    """What a document's chunks are together, and whether all keep to the sizes: none over the largest, only the last below the least."""
    data = t.documents.select("doc_id", F.col("text").cast("binary").alias("data"))
    parts = chunking.content_defined(data, kind, chunking.SMALL)
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "size", F.hex("data").alias("hex")))).alias("c"))
    fits = F.forall("c", lambda c: c["size"] <= chunking.SMALL.most) & F.forall(F.slice("c", F.lit(1), F.size("c") - 1), lambda c: c["size"] >= chunking.SMALL.least)
    digest = F.sha2(F.unhex(F.array_join(F.transform("c", lambda c: c["hex"]), "")), 256)
    return rows.select("doc_id", digest.alias("digest"), F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["size"]).alias("size"), fits.alias("fits"))


@query("chunk_rabin_whole", WHOLE)
def _(t):
    return whole_chunks(t, "rabin")


@query("chunk_fastcdc_whole", WHOLE)
def _(t):
    return whole_chunks(t, "fastcdc")


@query("manifest_flat", f"""with {CHUNKS} select doc_id, count(*) chunk_count, sum(length(chunk))::bigint total_size, 'flat' structure, 0 depth, count(*) root_children from chunks group by doc_id""")
def _(t):
    return blocks.manifest(chunks(t))


WIDTHS = """n as (select doc_id, count(*) n, sum(length(chunk))::bigint s from chunks group by doc_id), w as (select doc_id, n, s, n width, 0 depth from n union all select doc_id, n, s, (width + {f} - 1) // {f}, depth + 1 from w where width > {f})"""


@query("manifest_tree", f"""with recursive {CHUNKS}, {WIDTHS.format(f=3)}, top as (select doc_id, n, s, max(depth) depth, min(width) width from w group by all)
    select doc_id, n chunk_count, s total_size, case when n > 2 then 'tree' else 'flat' end structure, case when n > 2 then depth else 0 end::int depth, case when n > 2 then width else n end::bigint root_children from top""")
def _(t):
    return blocks.manifest(chunks(t), 2, 3)


@query("manifest_levels", f"""with recursive {CHUNKS}, {WIDTHS.format(f=4)}, b as (select doc_id, depth "level", width, lag(width) over (partition by doc_id order by depth) below from w where n > 4)
    select doc_id, "level"::int "level", node, least(4, below - node * 4)::bigint children from (select *, unnest(range(0, width)) node from b where "level" > 0)""")
def _(t):
    return blocks.tree_levels(chunks(t), 4, 4)


@query("manifest_node_ids", f"""with {CHUNKS}, {tree_sql(4, 4)} select doc_id, level::int "level", pos node, cid from nodes where level > 0""")
def _(t):
    c = chunks(t).select("doc_id", "idx", ids.cid_hex(F.col("chunk").cast("binary")).alias("cid"))
    return blocks.build_tree(c, 4, 4).select("doc_id", "level", "node", "cid")


@query("tree_read", f"""with {CHUNKS} select doc_id, idx pos, '01551220' || sha256(chunk) cid, case when contains(chunk, 'the') then null else 'missing_block' end error from chunks""")
def _(t):
    """All chunks of all documents, read from their roots down in order; those without a word of the list are not held."""
    made, _, _ = dag(t)
    c = chunks(t).select("doc_id", "idx", "size", "chunk", ids.cid_hex(F.col("chunk").cast("binary")).alias("cid"))
    return publish.read_tree(made.select("doc_id", "children"), blocks.build_tree(c, 3, 2), c.where(F.contains("chunk", F.lit("the"))).select("cid"))


@query("chunk_contains_offset", f"""with {CHUNKS} select doc_id, idx, "offset" <= 1500 and 1500 < "offset" + length(chunk) has from chunks""")
def _(t):
    return chunks(t).select("doc_id", "idx", blocks.contains_offset(F.col("offset"), F.col("size"), F.lit(1500)).alias("has"))


@query("read_byte_range", """select doc_id, case when strlen(text) > 1500 then hex(encode(text)[1501:least(2700, strlen(text))]) end data, case when strlen(text) <= 1500 then 'out_of_bounds' end error from documents where strlen(text) > 0""")
def _(t):
    data = F.col("text").cast("binary")
    size = F.octet_length("text")
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(700))
    cut = F.transform(starts, lambda s: F.substring(data, s + 1, F.lit(700)))
    c = t.documents.where(size > 0).select("doc_id", F.posexplode(cut).alias("idx", "chunk")).withColumn("size", F.octet_length("chunk"))
    return blocks.read_range(c, 1500, 2700).select("doc_id", F.hex("text").alias("data"), "error")


@query("read_range", """select doc_id, case when length(text) > 1500 then substr(text, 1501, least(2700, length(text)) - 1500) end "text", case when length(text) <= 1500 then 'out_of_bounds' end error from documents where length(text) > 0""")
def _(t):
    return blocks.read_range(chunks(t), 1500, 2700)


@query("read_all_verify", """select doc_id, sha256(text) digest from documents where length(text) > 0""")
def _(t):
    return blocks.read_all(chunks(t)).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("provider_waterfall", """with o as (select l_partkey cid, l_suppkey provider, l_linenumber, row_number() over (partition by l_partkey order by l_linenumber, l_suppkey, l_orderkey) rank_ from lineitem),
    o3 as (select *, row_number() over (partition by cid order by rank_, provider) n, provider % 4 = 0 has from o), f as (select cid, min(n) filter (where has and n <= 3) n, arg_min(provider, n) filter (where has and n <= 3) provider, max(n) filter (where n <= 3) tried from o3 group by cid)
    select p_partkey cid, case when p_partkey % 5 = 0 then 'local' when f.n is not null then f.provider::varchar else 'not_found' end origin, case when p_partkey % 5 = 0 then 0 else coalesce(f.n, tried, 0) end::bigint attempts from part left join f on cid = p_partkey""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_linenumber", "l_suppkey", "l_orderkey")
    offers = t.lineitem.select(F.col("l_partkey").alias("cid"), F.col("l_suppkey").cast("string").alias("provider"), F.row_number().over(w).alias("rank"), (F.col("l_suppkey") % 4 == 0).alias("has"))
    want = t.part.select(F.col("p_partkey").alias("cid"))
    return blocks.waterfall(want, want.where("cid % 5 = 0"), offers)


@query("provider_cap", """select l_partkey "key", l_suppkey provider, l_orderkey arrival from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) n from lineitem) where n <= 20""")
def _(t):
    return graph.per_key_cap(t.lineitem, "l_partkey", ["l_orderkey", "l_linenumber"], 20).select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("provider"), F.col("l_orderkey").alias("arrival"))


@query("extract_entities_parse", """select doc_id, 'person' "type", source "name", least(1.0, n_chars / 1000.0)::double confidence from documents where least(1.0, n_chars / 1000.0) >= 0.7""")
def _(t):
    answer = F.format_string('Here: ```json\n[{"type":"Person","name":" %s ","confidence":%s},{"type":"robot","name":"x","confidence":1},{"type":"date","name":" ","confidence":1}]\n```', F.col("source"), (F.col("n_chars") / 1000.0).cast("string"))
    return indexing.extract_entities(t.documents.select("doc_id", "source", "n_chars"), answer).select("doc_id", "type", "name", "confidence")


@query("keywords", """with w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) word from documents), tf as (select doc_id, word, count(*) tf from w where length(word) > 3 group by all), df as (select word, count(*) df from tf group by 1)
    select doc_id, word, tf, row_number() over (partition by doc_id order by round(tf * ln(((select count(*) from documents) + 1)::double / (df + 1)), 9) desc, word) place from tf join df using (word) qualify place <= 5""")
def _(t):
    return indexing.keywords(t.documents)


#: Lines of documents packed up to 1000 bytes, packs below 50 dropped: what an index run stores, by its chunks' sizes in characters.
PACKED = """p as (select doc_id, row_number() over (partition by doc_id order by k) n, part from (select doc_id, unnest(range(1, len(l) + 1)) k, trim(l[k], E' \\t\\n\\r') part from (select doc_id, string_split(text, E'\\n') l from documents where {fit})) where length(part) > 0),
    s as (select doc_id, n, case when strlen(part) >= 1000 then null else part end pack, case when strlen(part) >= 1000 then [part] else []::varchar[] end done from p where n = 1
      union all select p.doc_id, p.n,
        case when s.pack is null or strlen(s.pack) + strlen(p.part) + 2 > 1000 then case when strlen(p.part) >= 1000 then null else p.part end when strlen(s.pack) + strlen(p.part) + 2 >= 1000 then null else s.pack || E'\\n\\n' || p.part end,
        list_concat(s.done, case when s.pack is null then case when strlen(p.part) >= 1000 then [p.part] else []::varchar[] end
          when strlen(s.pack) + strlen(p.part) + 2 > 1000 then list_concat(case when strlen(s.pack) >= 50 then [s.pack] else []::varchar[] end, case when strlen(p.part) >= 1000 then [p.part] else []::varchar[] end)
          when strlen(s.pack) + strlen(p.part) + 2 >= 1000 then [s.pack || E'\\n\\n' || p.part] else []::varchar[] end)
      from s join p on p.doc_id = s.doc_id and p.n = s.n + 1),
    e as (select doc_id, arg_max(list_concat(done, case when pack is not null and strlen(pack) >= 50 then [pack] else []::varchar[] end), n) l from s group by doc_id),
    packed as (select doc_id, i - 1 chunk_index, length(l[i]) size from (select doc_id, l, unnest(range(1, len(l) + 1)) i from e))"""
FIT = r"""not contains(text, chr(0)) and length(text) > 0 and length(regexp_replace(text, '[!-~\s\x{85}\x{a0}]', '', 'g'))::double / length(text) <= 0.3 and strlen(trim(text)) >= 1"""


@query("index_space", f"""with recursive {PACKED.format(fit=FIT)} select doc_id, chunk_index, size, 64 dimensions from packed""")
def _(t):
    return indexing.index(t.documents, 50, 1000, 64).select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("size"), F.size("embedding").alias("dimensions"))


@query("index_status", f"""with recursive {PACKED.format(fit=FIT)}, c as (select doc_id, count(*) n from packed group by 1) select source, count(n) files_indexed, coalesce(sum(n), 0)::bigint chunks_stored, count(*) filter (where n is null) files_skipped from documents left join c using (doc_id) group by source""")
def _(t):
    return indexing.index_status(t.documents.select("doc_id", "source"), indexing.index(t.documents, 50, 1000, 4).select("doc_id"), "source")


@query("index_remote", f"""with recursive {PACKED.format(fit=FIT + " and doc_id not in (select doc_id from labels)")} select doc_id, chunk_index, size from packed""")
def _(t):
    content = t.documents.select("doc_id", F.lit("text/plain").alias("content_type"), F.col("text").cast("binary").alias("data"))
    return indexing.index_remote(content, t.labels, 50, 1000, 64).select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("size"))


@query("remote_fetch_retry", """with a as (select l_orderkey cid, row_number() over (partition by l_orderkey order by l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000) n, l_returnflag = 'R' ok from lineitem)
    select cid, case when min(n) filter (where ok and n <= 3) is not null then 'fetched' else 'fetch_failed' end status, coalesce(min(n) filter (where ok and n <= 3), max(n) filter (where n <= 3)) tries from a group by cid""")
def _(t):
    return indexing.fetched(t.lineitem.select(F.col("l_orderkey").alias("cid"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("attempt"), (F.col("l_returnflag") == "R").alias("ok")))


@query("extract_and_store", """select doc_id, 1 space_id, 'person' entity_type, source "name", '{"confidence":' || least(1.0, n_chars / 1000.0)::double || ',"source_path":"/' || source || '"}' properties, 'me' created_by from documents where least(1.0, n_chars / 1000.0) >= 0.7 and length(trim(text)) > 0""")
def _(t):
    answer = F.format_string('[{"type":"Person","name":"%s","confidence":%s},{"type":"robot","name":"x","confidence":1}]', F.col("source"), F.least(F.lit(1.0), F.col("n_chars") / 1000.0).cast("double").cast("string"))
    chunks_ = t.documents.select("doc_id", F.concat(F.lit("/"), "source").alias("source_path"), "text", "source", "n_chars")
    return indexing.stored_entities(chunks_, answer, F.lit(1), F.lit("me"))


TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9à-öø-ÿ]+')"
MENTIONS = f"""i as (select item_id, {TOKENS.format(x="text")} w from benchmark),
    dict as (select term, min(type) type, len(string_split(term, ' ')) n from (select array_to_string(w[1:2], ' ') term, 'concept' type from i where len(w) >= 2 union all select array_to_string(w[3:5], ' '), 'location' from i where len(w) >= 5
      union all select w[3], 'person' from i where len(w) >= 3 and length(w[3]) >= 4) group by term),
    d as (select doc_id, {TOKENS.format(x="text")} w from documents), s as (select doc_id, w, unnest(range(len(w))) pos from d),
    g as (select doc_id, pos, n, array_to_string(w[pos + 1:pos + n], ' ') term from s, range(1, 4) r(n)),
    f as (select doc_id, pos, k.n, term, type from g join dict k using (term, n) qualify row_number() over (partition by doc_id, pos order by k.n desc) = 1),
    o as (select *, row_number() over (partition by doc_id order by pos) r from f),
    k as (select doc_id, r, pos, n, term, type, pos + n finish, true kept from o where r = 1
      union all select o.doc_id, o.r, o.pos, o.n, o.term, o.type, case when o.pos >= k.finish then o.pos + o.n else k.finish end, o.pos >= k.finish from k join o on o.doc_id = k.doc_id and o.r = k.r + 1),
    m as (select *, (50 + case when n > 1 then 20 else 0 end + case when count(*) over (partition by doc_id, term) > 1 then 20 else 0 end
        + case when coalesce(pos - lag(pos + n) over w < 10 and lag(term) over w <> term, false) or coalesce(lead(pos) over w - pos - n < 10 and lead(term) over w <> term, false) then 10 else 0 end) / 100.0::double confidence from k where kept window w as (partition by doc_id order by pos))"""


def dictionary(t):
    """Terms of one to three tokens from the benchmark's items."""
    w = t.benchmark.select(mentions.tokens(F.col("text")).alias("w"))
    part = lambda a, n, kind, more=F.lit(True): w.where((F.size("w") >= a + n - 1) & more).select(F.array_join(F.slice("w", a, n), " ").alias("term"), F.lit(kind).alias("type"))
    return part(1, 2, "concept").union(part(3, 3, "location")).union(part(3, 1, "person", F.length(F.get("w", F.lit(2))) >= 4))


@query("entity_mentions", f"""with recursive {MENTIONS} select doc_id, pos::bigint pos, n, term, type, confidence from m""")
def _(t):
    rows = mentions.scored(mentions.settled(mentions.found(t.documents, dictionary(t))))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"), "term", "type", "confidence")


@query("entity_extract", f"""with recursive {MENTIONS} select doc_id, type, term "name", count(*) mentions, min(pos)::bigint first_pos, max(confidence) confidence from m where confidence >= 0.7 group by doc_id, type, term""")
def _(t):
    return mentions.extracted(t.documents, dictionary(t))


@query("did_web_url", """select page_id, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/.well-known/did.json' url from pages""")
def _(t):
    did = F.concat(F.lit("did:web:"), F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return t.pages.select("page_id", strings.did_web_url(did).alias("url"))


DIDS = """d as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) host from pages)"""


def dids(t):
    """Every page's host as a web identifier, with a port and a path for some, and as one of another method."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    kinds = [F.concat(F.lit("did:web:"), host), F.concat(F.lit("did:web:"), host, F.lit("%3A8080:users:b")), F.concat(F.lit("did:key:z6Mk"), host), F.concat(F.lit("did:web:"), host, F.lit(":..:x"))]
    return t.pages.select("page_id", F.element_at(F.array(*kinds), (F.col("page_id") % 4 + 1).cast("int")).alias("did"))


@query("did_methods", f"""with {DIDS} select page_id, case page_id % 4 when 2 then 'key' else 'web' end "method", case page_id % 4 when 2 then 86400 else 300 end "seconds",
    case page_id % 4 when 0 then 'https://' || host || '/.well-known/did.json' when 1 then 'https://' || host || ':8080/users/b/did.json' end url from d""")
def _(t):
    d = dids(t)
    method = strings.did_method(F.col("did"))
    return d.select("page_id", method.alias("method"), strings.did_cache_seconds(method).alias("seconds"), strings.did_web_url(F.col("did")).alias("url"))


@query("did_peer_parse", """select c_custkey, case c_custkey % 3 when 0 then 0 when 1 then 2 end numalgo, case c_custkey % 3 when 0 then 'verification:Ed25519:' || sha256(c_name) when 1 then 'encryption:X25519:' || sha256(c_name) else '' end keys, case c_custkey % 3 when 2 then 'format' end error from customer""")
def _(t):
    """Customers' names, digested, as keys: the identifiers are made from them and read again."""
    made = t.customer.select("c_custkey", F.sha2("c_name", 256).alias("key"))
    key = strings.multikey(F.concat(F.when(F.col("c_custkey") % 3 == 0, "ed01").otherwise("ec01"), F.col("key")))
    d = made.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("did:peer:0"), key)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("did:peer:2.E"), key)).otherwise("did:peer:x").alias("did"))
    found = d.select("c_custkey", strings.did_peer_parse("did").alias("p"))
    named = F.transform("p.keys", lambda k: F.concat_ws(":", k["purpose"], k["type"], k["key"]))
    return found.select("c_custkey", "p.numalgo", F.array_join(named, ",").alias("keys"), "p.error")
