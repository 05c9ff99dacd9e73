"""Queries over stored vector indexes, and answers by retrieval."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalogue import query
from lodestone.functions import summaries, vectors
from lodestone.operators import federation, indexing, retrieval
from lodestone.operators.ann import VectorIndex
from lodestone.plans.content import FIT, PACKED
from lodestone.sources import files, frames

CELLS, PROBES, ROUNDS = 16, 10, 2


def indexed(t) -> VectorIndex:
    """Half of the vectors in a first flush, all in a second: what is held stays."""
    index = VectorIndex.create(t.embeddings, files.shared(t.spark, "index"), cells=CELLS, subspaces=16, rounds=ROUNDS)
    index.add(t.embeddings.where("vec_id % 2 = 0"))
    index.flush()
    index.add(t.embeddings.where("vec_id % 3 <> 1"))
    index.add(t.embeddings)
    index.flush()
    return VectorIndex.load(t.spark, index.path)


def many(t) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _cells_sql() -> str:
    """Common table expressions: c0 to c2, the centroids after each round, and assigned (vec_id, v, cell)."""
    out = [f"e as (select vec_id, {_unit('embedding::double[]')} v, row_number() over (order by md5(vec_id::varchar), vec_id) - 1 place from embeddings)", f"c0 as (select place cell, v c from e where place < {CELLS})"]
    nearest = "select e.vec_id, e.v, c.cell from e, c{k} c qualify row_number() over (partition by e.vec_id order by round(list_dot_product(e.v, c.c), 12) desc, c.cell) = 1"
    for k in range(ROUNDS):
        out.append(f"a{k} as ({nearest.format(k=k)})")
        out.append(f"s{k} as (select cell, list(x order by d) v from (select cell, d, sum(v[d]) x from (select cell, v, unnest(range(1, len(v) + 1)) d from a{k}) group by cell, d) group by cell)")
        out.append(f"c{k + 1} as (select c.cell, case when s.v is null then c.c else {_unit('s.v')} end c from c{k} c left join s{k} s using (cell))")
    out.append(f"assigned as ({nearest.format(k=ROUNDS)})")
    return ",\n    ".join(out)


@query("ann_ivf", f"""with {_cells_sql()},
    probes as (select e.vec_id query_id, e.v q, c.cell from e, c{ROUNDS} c where e.vec_id % 50 = 0 qualify row_number() over (partition by e.vec_id order by round(list_dot_product(e.v, c.c), 12) desc, c.cell) <= {PROBES})
    select query_id, vec_id, round(1 - list_dot_product(q, v), 6) distance, row_number() over (partition by query_id order by round(1 - list_dot_product(q, v), 12), vec_id) "rank"
    from probes join assigned using (cell) where vec_id <> query_id qualify "rank" <= 10""")
def _(t):
    near = indexed(t).search(many(t), 10, probes=PROBES)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("ann_ivf_codes")
def _(t):
    """The codes choose a tenth of the rows that the probed cells hold, whose vectors are compared."""
    near = indexed(t).search(many(t), 10, probes=PROBES, shortlist=100)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("ann_cells", f"""with {_cells_sql()} select vec_id, cell::int cell, case when vec_id % 2 = 0 then 0 else 1 end flush from assigned""")
def _(t):
    return indexed(t).rows().select(F.col("id").alias("vec_id"), "cell", "flush")


WORDS = "list_filter(string_split(regexp_replace(lower({x}), '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda x: x <> '')"
SPOTS = "select {key}, ('0x' || substr(md5(w), 1, 8))::bigint % 64 d, sum(case when substr(md5(w), 9, 1) < '8' then 1 else -1 end)::double v from (select {key}, unnest({words}) w from {rows}) group by all"


@query("rag_fused", f"""with recursive {PACKED.format(fit=FIT)},
    chunks as (select doc_id * 1048576 + chunk_index chunk_id, l[chunk_index + 1] chunk from packed join e using (doc_id)),
    parts as (select item_id q, text, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.?!;\n]+'), lambda x: trim(x, ' ')), lambda x: contains(x, ' '))) p from benchmark where length(trim(text, ' ')) > 0),
    asked as (select row_number() over () a, * from (select q, unnest(case when len(p) > 1 then list_prepend(text, p) else [text] end) part from parts)),
    av as ({SPOTS.format(key="a", words=WORDS.format(x="part"), rows="asked")}), cv as ({SPOTS.format(key="chunk_id", words=WORDS.format(x="chunk"), rows="chunks")}),
    an as (select a, sqrt(sum(v * v)) n from av group by a), cn as (select chunk_id, sqrt(sum(v * v)) n from cv group by chunk_id),
    dots as (select a, chunk_id, sum(av.v * cv.v) dot from av join cv using (d) group by a, chunk_id),
    far as (select asked.a, q, c.chunk_id, round(case when coalesce(an.n, 0) * coalesce(cn.n, 0) = 0 then 1.0 else 1 - coalesce(dot, 0) / (an.n * cn.n) end, 12) far
        from asked cross join chunks c left join an on an.a = asked.a left join cn on cn.chunk_id = c.chunk_id left join dots on dots.a = asked.a and dots.chunk_id = c.chunk_id),
    near as (select *, row_number() over (partition by a order by far, chunk_id) r from far qualify r <= 20),
    fused as (select q, chunk_id, round(sum(1.0 / (60.0::double + r)), 12) score from near group by q, chunk_id),
    top as (select q, chunk_id, row_number() over (partition by q order by score desc, chunk_id) "rank" from fused qualify "rank" <= 20),
    w as (select q, chunk_id, chunk, "rank", list_distinct(regexp_split_to_array(lower(b.text), '[^A-Za-z0-9_]+')) asked, list_distinct(regexp_split_to_array(lower(chunk), '[^A-Za-z0-9_]+')) words from top join chunks using (chunk_id) join benchmark b on b.item_id = q),
    best as (select q, chunk_id, chunk, row_number() over (partition by q order by len(list_intersect(asked, words))::double / len(asked) desc, "rank") n from w qualify n <= 5),
    done as (select q, string_agg('[Source ' || n || ']' || chr(10) || chunk || chr(10), chr(10) order by n) context, string_agg(chunk_id::varchar, ',' order by n) sources from best group by q)
    select b.item_id q, 'Answer from the context, citing [Source N]; say so if it doesn''t hold the answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:' prompt, sources, case when context is null then 'NO_CONTEXT' end error
    from benchmark b left join done on done.q = b.item_id""")
def _(t):
    """Every benchmark item as a question over the chunks of all documents."""
    chunks = indexing.index(t.documents, 50, 1000, 64, embedder=vectors.word_counts).select((F.col("doc_id") * 1048576 + F.col("chunk_index")).alias("chunk_id"), "chunk", "embedding")
    asked = t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    out = retrieval.answered(asked, chunks, dimensions=64, embedder=functools.partial(vectors.word_counts))
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


def _ranks_sql(rounds: int) -> str:
    """Common table expressions r0 to r{rounds} (doc_id, s, x): each sentence's rank after a round."""
    out = ["r0 as (select doc_id, s, 1.0::double / n x from n)"]
    for k in range(1, rounds + 1):
        out.append(f"w{k} as (select a.doc_id, w, sum(share * x * flow) y from a join r{k - 1} r using (doc_id, s) join deg using (doc_id, s) group by all)")
        out.append(f"r{k} as (select doc_id, s, 0.15 / n.n + 0.85 * (g.y - r.x * flow) x from (select doc_id, s, sum(share * y) y from a join w{k} using (doc_id, w) group by all) g join n using (doc_id, s) join r{k - 1} r using (doc_id, s) join deg using (doc_id, s))")
    return ",\n    ".join(out)


@query("summaries", f"""with parts as (select doc_id, unnest(range(len(p))) s, unnest(p) part from (select doc_id, regexp_split_to_array(text, '[.!?\n]+') p from documents)),
    held as (select doc_id, s, trim(part, ' ') part, list_distinct(list_filter(regexp_extract_all(lower(part), '[a-z0-9à-öø-ÿ]+'), lambda w: length(w) > 3)) w from parts),
    n as (select doc_id, s, part, w, count(*) over (partition by doc_id) n from held where len(w) > 0),
    a as (select doc_id, s, unnest(w) w, 1 / sqrt(len(w)::double) share from n),
    deg as (select doc_id, s, case when round(sum(share * c) - 1, 12) > 0 then 1 / round(sum(share * c) - 1, 12) else 0 end flow from a join (select doc_id, w, sum(share) c from a group by all) using (doc_id, w) group by doc_id, s),
    {_ranks_sql(summaries.ROUNDS)},
    best as (select doc_id, s, part, n from n join r{summaries.ROUNDS} using (doc_id, s) qualify row_number() over (partition by doc_id order by round(x, 9) desc, s) <= 3)
    select d.doc_id, coalesce(string_agg(part, ' ' order by s), '') summary, coalesce(any_value(n), 0) sentences from documents d left join best using (doc_id) group by d.doc_id""")
def _(t):
    return summaries.summarised(t.documents)


@query("frames_round_trip", """select event_id, event_type, round(value, 4) amount, (props::json->>'k')::bigint k from events""")
def _(t):
    """All events written as frames of CBOR, and read in parts as Variants."""
    spark, out = t.spark, files.shared(t.spark, "frames")
    spark.dataSource.register(frames.Frames)
    message = F.to_json(F.struct("event_id", "event_type", "value", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k")))
    t.events.select(message.alias("message")).write.format(frames.Frames.name()).mode("append").save(out)
    held = spark.read.format(frames.Frames.name()).option("part", str(1 << 18)).load(out).select(F.parse_json("message").alias("m"))
    of = lambda key, kind: F.variant_get("m", f"$.{key}", kind)
    return held.select(of("event_id", "long").alias("event_id"), of("event_type", "string").alias("event_type"), F.round(of("value", "double"), 4).alias("amount"), of("k", "long").alias("k"))


@query("search_cached", """with alls as (select q.vec_id query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]) distance from embeddings e join embeddings q on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)
    select query_id, vec_id, round(1 - distance, 6) score, query_id % 100 = 0 hit from alls qualify row_number() over (partition by query_id order by distance, vec_id) <= 10""")
def _(t):
    """Queries whose id is divisible by 100 are answered first; then every one divisible by 50, half of them from the cache."""
    cache = federation.SearchCache(t.spark, files.shared(t.spark, "answers"))
    table = federation.Table(t.embeddings, "local:a")
    asked = many(t).withColumn("query", F.col("query_id").cast("string")).withColumn("scope", F.lit("local"))
    cache.through(table, asked.where("query_id % 100 = 0"), 10, 1_000)
    rows, hits = cache.through(table, asked, 10, 2_000)
    return rows.join(hits, "query_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "hit")


class Broken(federation.Table):
    def search(self, query, limit):
        return super().search(query, limit).withColumn("score", F.raise_error(F.lit("out of order")).cast("double"))


@query("search_partial", """with sims as (select q.vec_id query_id, e.vec_id, case e.label % 3 when 0 then 'local:a' else 'network:p3' end source_id, 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]) distance
      from embeddings e join embeddings q on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id where e.label % 3 <> 1)
    select query_id, vec_id, source_id, round(1 - distance, 6) score from sims qualify row_number() over (partition by query_id, source_id order by distance, vec_id) <= 10""")
def _(t):
    """A search over four sources of the vectors, of which one fails at work and one says so before: what the others have."""
    part = lambda k: t.embeddings.where(F.col("label") % 3 == k)
    adapters = [federation.Table(part(0), "local:a"), Broken(part(1), "network:p1", "network"), federation.Table(part(1).drop("embedding"), "network:p2", "network"), federation.Table(part(2), "network:p3", "network")]
    rows, _ = federation.searched(adapters, many(t), 10, needed=2)
    return rows.select("query_id", "vec_id", "source_id", F.round("score", 6).alias("score"))
