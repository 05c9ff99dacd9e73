"""Search queries: vectors stand for collections, labels choose their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import extensions
from lodestone.catalogue import query
from lodestone.functions import ids, strings, vectors
from lodestone.operators import indexing, search

SOURCES = "case s when 0 then label between 0 and 5 when 1 then label between 3 and 8 else label % 2 = 0 end"
NAMES = ["local:a", "network:p1", "network:p2"]
SIM = """
sims as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) score
         from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.vec_id <> 0)"""
SOURCED = f"""
with {SIM},
rows_ as (select vec_id, score, ['local:a', 'network:p1', 'network:p2'][s + 1] source_id, case when s = 0 then 'local' else 'network' end source
          from sims, (select unnest([0, 1, 2]) s) where {SOURCES}),
kept as (select * from (select *, row_number() over (partition by source_id order by score desc, vec_id) r from rows_) where r <= 20)"""


def _planes_sql(planes: int = 16, dimensions: int = 64, seed: int = 7) -> str:
    """The random projections' signs, written out."""
    import numpy as np

    rows = np.random.default_rng(seed)
    dots = (f"case when list_dot_product(embedding::double[], [{', '.join(repr(float(x)) for x in rows.normal(size=dimensions))}]) >= 0 then {1 << p} else 0 end" for p in range(planes))
    return f"({' + '.join(dots)})::bigint"


PLANES_SQL = _planes_sql()


def aggregate_sql(penalty: float, boost: float) -> str:
    return f"""{SOURCED},
    normed as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end norm from kept window w as (partition by source_id)),
    pen as (select *, case when source = 'network' then norm * {penalty} else norm end pen from normed),
    grouped as (select vec_id, count(*) sources_count, max(pen) score, max(case when source = 'local' then 1 else 0 end) l, arg_min(source_id, (-pen, source_id)) source_id from pen group by vec_id),
    adj as (select *, score + least({boost} * (sources_count - 1), 0.3) adjusted_score from grouped)
    select vec_id, sources_count, round(score, 6) score, round(adjusted_score, 6) adjusted_score, case when l = 1 then 'local' else 'network' end source, source_id,
           (select count(*) from adj) total_unique, greatest((select count(*) from adj) - 10, 0)::bigint overflow
    from adj order by adjusted_score desc, vec_id limit 10"""


def sourced(t):
    """The rows of three overlapping sources, with their similarity to vector 0."""
    e = t.embeddings
    sims = search.similarities(e, one(t))
    spread = sims.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(F.expr(SOURCES))
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("s") + 1)
    return spread.select("vec_id", "score", name.alias("source_id"), F.when(F.col("s") == 0, "local").otherwise("network").alias("source"))


def one(t):
    """Vector 0 as a query."""
    return t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def many(t):
    """Every vector whose id is divisible by 50."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


ALL_SIMS = """alls as (select q.vec_id query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]) distance from embeddings e join embeddings q on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("search_aggregate", aggregate_sql(0.9, 0.1))
def _(t):
    return rounded(search.aggregate(search.top_per_source(sourced(t), 20), 10), "score", "adjusted_score")


@query("search_no_penalty_no_boost", aggregate_sql(1.0, 0.0))
def _(t):
    return rounded(search.aggregate(search.top_per_source(sourced(t), 20), 10, penalties=False, boost=False), "score", "adjusted_score")


@query("search_response_counts", f"""with r as ({aggregate_sql(0.9, 0.1)})
    select count(*) filter (where source = 'local') local_count, count(*) filter (where source = 'network') network_count, max(overflow) more_available,
           (count(*) + max(overflow))::bigint total_found from r""")
def _(t):
    return search.response_counts(search.aggregate(search.top_per_source(sourced(t), 20), 10))


@query("federated_topk", f"""{SOURCED}
    select vec_id, source_id, source, round(score, 6) score, round(case when source = 'local' then score else score * 0.9 end, 6) adjusted_score
    from kept order by case when source = 'local' then score else score * 0.9 end desc, vec_id, source_id limit 15""")
def _(t):
    return rounded(search.federated(sourced(t), 20, 15), "score", "adjusted_score").select("vec_id", "source_id", "source", "score", "adjusted_score")


@query("scope_local", f"""{SOURCED} select vec_id, source_id, round(score, 6) score from kept where source = 'local'""")
def _(t):
    return rounded(search.in_scope(search.top_per_source(sourced(t), 20), "local").select("vec_id", "source_id", "score"), "score")


@query("scope_network", f"""{SOURCED} select vec_id, source_id, round(score, 6) score from kept where source = 'network'""")
def _(t):
    return rounded(search.in_scope(search.top_per_source(sourced(t), 20), "network").select("vec_id", "source_id", "score"), "score")


class Collection:
    """One source's vectors as an adapter."""

    def __init__(self, rows, source_id: str):
        self.rows, self.name, self.scope = rows, source_id, source_id.split(":")[0]

    def search(self, query, limit):
        near = search.knn(self.rows, query, limit).select("vec_id", (1.0 - F.col("distance")).alias("score"))
        return near.select("vec_id", "score", F.lit(self.name).alias("source_id"), F.lit(self.scope).alias("source"))


@query("adapters_all", f"""{SOURCED} select vec_id, source_id, source, round(score, 6) score from kept""")
def _(t):
    rules = ["label between 0 and 5", "label between 3 and 8", "label % 2 = 0"]
    adapters = [Collection(t.embeddings.where(r), n) for r, n in zip(rules, NAMES, strict=True)]
    return rounded(extensions.gathered(adapters, one(t), 20).select("vec_id", "source_id", "source", "score"), "score")


@query("knn_cosine_topk", f"""with {SIM} select vec_id, label, round(1 - score, 6) distance from sims order by 1 - score, vec_id limit 10""")
def _(t):
    near = search.knn(t.embeddings, one(t), 10)
    return rounded(near.join(t.embeddings.select("vec_id", "label"), "vec_id"), "distance").select("vec_id", "label", "distance")


@query("knn_many", f"""with {ALL_SIMS} select query_id, vec_id, round(distance, 6) distance, row_number() over (partition by query_id order by distance, vec_id) "rank" from alls qualify "rank" <= 10""")
def _(t):
    return rounded(search.knn(t.embeddings, many(t), 10, most=4), "distance").select("query_id", "vec_id", "distance", "rank")


@query("knn_threshold", f"""with {SIM}, near as (select *, 1 - score distance from sims order by 1 - score, vec_id limit 20)
    select vec_id, round(distance, 6) distance from near where distance <= 0.8 order by distance, vec_id limit 10""")
def _(t):
    return rounded(search.knn(t.embeddings, one(t), 10, at_most=0.8), "distance").select("vec_id", "distance")


@query("knn_prefiltered", f"""with {ALL_SIMS}, s as (select vec_id, {PLANES_SQL} signature from embeddings),
    near as (select a.* from alls a join s q on q.vec_id = query_id join s e on e.vec_id = a.vec_id where bit_count(xor(q.signature, e.signature)) <= 9)
    select query_id, vec_id, round(distance, 6) distance from near qualify row_number() over (partition by query_id order by distance, vec_id) <= 10""")
def _(t):
    return rounded(search.knn_prefiltered(t.embeddings, many(t), 10), "distance").select("query_id", "vec_id", "distance")


@query("vector_guards", """select label, count(*) filter (where len(embedding) = 64) fit, count(*) filter (where list_cosine_similarity(embedding::double[], embedding::double[]) > 0.999999) self_near,
    count(*) zero_distance_one from embeddings group by label""")
def _(t):
    zero = F.array_repeat(F.lit(0.0), 64)
    v = F.col("embedding")
    return t.embeddings.groupBy("label").agg(F.count_if(vectors.has_dimension(v, 64)).alias("fit"), F.count_if(vectors.cosine_distance(v, v) < 1e-6).alias("self_near"), F.count_if(vectors.cosine_distance(v, zero) == 1.0).alias("zero_distance_one"))


@query("vector_norms", """select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) norm from embeddings""")
def _(t):
    return t.embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("vector_index_add", """with a as (select vec_id, label, 0 batch from embeddings where label < 6), b as (select vec_id, label + 100 label, 1 batch from embeddings where label > 3)
    select vec_id, label, batch from a union all select vec_id, label, batch from b where vec_id not in (select vec_id from a)""")
def _(t):
    from lodestone.operators import graph

    e = t.embeddings.select("vec_id", "label")
    held = e.where("label < 6").withColumn("batch", F.lit(0))
    return graph.insert_if_absent(held, e.where("label > 3").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("batch")), "vec_id", ["vec_id"])


@query("collection_discovery", """select distinct 'space-' || source || '-idx' collection from documents where lang <> 'zz'""")
def _(t):
    from lodestone.sources import files

    named = t.documents.select(F.concat(F.lit("space-"), "source", F.lit("-idx")).alias("collection"))
    return files.collections(named.unionByName(t.benchmark.select(F.concat(F.lit("remote-"), F.col("item_id").cast("string")).alias("collection"))))


VALID = """case when text is null or length(trim(text)) = 0 then 'EMPTY_QUERY' when strlen(text) > 1000 then 'QUERY_TOO_LONG'
    when lower(role) not in ('local', 'network', 'all', 'user') then 'INVALID_SCOPE' when turn < 1 or turn > 3 then 'INVALID_LIMIT' end"""


@query("request_validation", f"""select conv_id, turn, {VALID} error from conversations""")
def _(t):
    scope = F.when(F.col("role") == "user", "all").otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", search.request_error(F.col("text"), scope, F.col("turn"), most=3).alias("error"))


@query("query_message_validation", """select event_id, case when strlen(event_type) < 1 or strlen(event_type) > 1000 then 'INVALID_QUERY' when value::bigint < 1 or value::bigint > 100 then 'INVALID_LIMIT'
    when (epoch_us(ts) // 1000) < 1705276800000 - 60000 then 'EXPIRED' end error from events""")
def _(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", search.query_message_error(F.col("event_type"), F.bround("value", 0).cast("long"), ms, F.lit(1705276800000)).alias("error"))


@query("query_responder_gate", """select event_id, least(user_id, 20) "limit" from events where user_id between 1 and 100 and event_type <> 'view'""")
def _(t):
    m = t.events.select("event_id", F.col("event_type").alias("peer"), F.col("user_id").alias("limit"))
    m = m.withColumn("error", search.query_message_error(F.col("peer"), F.col("limit"), F.lit(1), F.lit(0)))
    return search.answerable(m, F.lit("view"), True, 20).select("event_id", "limit")


@query("cache_key", """select conv_id, turn, substr(sha256(encode(text) || encode(role) || unhex('14000000')), 1, 32) cache_key from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", ids.cache_key(F.col("text"), F.col("role"), 20).alias("cache_key"))


@query("cache_replay_stats", """with k as (select user_id, event_type, (epoch_us(ts) // 1000) ms from events), seen as (select *, lag(ms) over (partition by user_id, event_type order by ms) prev from k)
    select count(*) lookups, count(*) filter (where prev is not null and ms - prev <= 21600000) hits, count(*) filter (where prev is null or ms - prev > 21600000) misses,
    round(100.0 * count(*) filter (where prev is not null and ms - prev <= 21600000) / count(*), 6) hit_rate from seen""")
def _(t):
    from pyspark.sql import Window

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    seen = t.events.withColumn("ms", ms).withColumn("prev", F.lag("ms").over(Window.partitionBy("user_id", "event_type").orderBy("ms")))
    hit = F.coalesce(F.col("ms") - F.col("prev") <= 21600000, F.lit(False))
    out = seen.agg(F.count(F.lit(1)).alias("lookups"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return out.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("lookups")), F.lit(0.0)), 6))


STATUS = {"click": "INVALID_QUERY", "view": "TIMEOUT", "purchase": "NETWORK_UNAVAILABLE", "error": "INTERNAL_ERROR", "signup": "QDRANT_ERROR"}


@query("error_status", """select event_id, case event_type when 'click' then 400 when 'view' then 504 when 'purchase' then 503 else 500 end status from events""")
def _(t):
    """Each kind of event as an error's code."""
    code = strings.literal_map(STATUS)[F.col("event_type")]
    return t.events.select("event_id", strings.literal_map(strings.ERRORS)[code].alias("status"))


@query("snippets", """select conv_id, turn, case when length(text) > 150 then substr(text, 1, 150) || '...' else text end snippet, substr(text, 1, 4000) body from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", strings.snippet(F.col("text")).alias("snippet"), strings.truncated(F.col("text")).alias("body"))


@query("rag_context", """with r as (select conv_id, text, row_number() over (partition by conv_id order by turn) n from conversations)
    select conv_id, string_agg('[Source ' || n || ']' || chr(10) || text || chr(10), chr(10) order by n) context from r where n <= 5 group by conv_id""")
def _(t):
    return indexing.rag_context(t.conversations.select("conv_id", F.col("turn").alias("rank"), F.col("text").alias("content")), "conv_id")


@query("rag_citations", """with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) citation from conversations) select * from r where citation <= 5""")
def _(t):
    return indexing.citations(t.conversations.select("conv_id", "turn", F.col("turn").alias("rank")), "conv_id").select("conv_id", "turn", "citation")


@query("rag_pipeline", """with q as (select item_id q, text question, list_distinct(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) asked from benchmark),
    d as (select doc_id, text content, regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+') words from documents where doc_id in (select doc_id from labels)),
    r as (select q, question, asked, doc_id, content, words, row_number() over (partition by q order by abs(length(content) - length(question)), doc_id) "rank" from q, d qualify "rank" <= 20),
    s as (select q, question, content, row_number() over (partition by q order by len(list_intersect(asked, list_distinct(words)))::double / len(asked) desc, "rank") n from r)
    select q, 'Answer from the context, citing [Source N]; say so if it doesn''t hold the answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[Source ' || n || ']' || chr(10) || content || chr(10), chr(10) order by n) || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Answer:' prompt, null::varchar error from s where n <= 5 group by q""")
def _(t):
    """Every benchmark item as a question: retrieval among labelled documents by a stand-in's vector (a text's length), reranking, context and prompt."""
    from pyspark.sql import Window

    docs = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").alias("content"))
    asked = t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    sizes, met = docs.select("doc_id", F.length("content").alias("size")), None
    for block in search.blocks_of(asked.select(F.col("q").alias("query_id"), F.length("question").alias("wanted")), 512):  # ids and lengths of a checked number of questions
        part = sizes.crossJoin(F.broadcast(block.withColumnRenamed("query_id", "q"))).select("q", "doc_id", F.abs(F.col("size") - F.col("wanted")).alias("far"))
        met = part if met is None else met.unionByName(part)
    top = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("far", "doc_id"))).where("rank <= 20")
    return indexing.answers(asked, indexing.rerank(top.join(docs, "doc_id").join(asked, "q"), "q"))
