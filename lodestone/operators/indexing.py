"""File validation, index runs, metrics and thresholds, retrieval for answers, extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.extensions import Embedder
from lodestone.functions import chunking, strings, vectors
from lodestone.sources import files


def skip_reason(path: Column, text: Column, size: Column, most: int, patterns: list[str], least: int) -> Column:
    """too_large, binary, excluded or too_small; null for a file to index."""
    return (
        F.when(size > most, "too_large").when(strings.is_binary(text), "binary").when(strings.excluded(path, patterns).isNotNull(), "excluded")
        .when(F.octet_length(F.trim(text)) < F.greatest(F.lit(least), F.lit(1)), "too_small")
    )


def unindexed(files: DataFrame, index: DataFrame, key: str = "digest") -> DataFrame:
    return files.join(index.select(key), key, "left_anti")


def metrics(rows: DataFrame, by: str) -> DataFrame:
    """(loaded, skipped, failed, chunks, failure_rate) by group from (status, chunks) rows."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy(by).agg(n("loaded").alias("loaded"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.sum("chunks").cast("long").alias("chunks"))
    return out.withColumn("failure_rate", F.coalesce(F.try_divide(F.col("failed"), F.col("loaded") + F.col("failed")), F.lit(0.0)))


def threshold_status(rate: Column, total: Column, most: float, sample: int) -> Column:
    return F.when(total < sample, "insufficient_data").when(rate > 1.5 * most, "catastrophic").when(rate > most, "critical").when(rate > 0.5 * most, "warning").otherwise("ok")


def final_error(loaded: Column, failed: Column, most: float, sample: int) -> Column:
    rate = failed / (loaded + failed)
    return F.when(loaded + failed < sample, F.lit(None).cast("string")).when(rate > most, "failure_rate").when((loaded == 0) & (failed > 0), "zero_success")


def index(docs: DataFrame, least: int, most: int, dimensions: int = 384, separator: str = "\n", embedder: Embedder = vectors.embed) -> DataFrame:
    """(doc_id, chunk_index, chunk, embedding): validated, packed and embedded texts. embedder: a column of texts and a number of dimensions to a column of vectors."""
    fit = docs.where(skip_reason(F.lit(""), F.col("text"), F.octet_length("text"), 100 << 20, [], 1).isNull())
    parts = chunking.packed(fit, least, most, separator)
    return parts.withColumn("embedding", embedder(F.col("chunk"), dimensions)).withColumnRenamed("idx", "chunk_index")


def index_status(files: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(by, files_indexed, chunks_stored, files_skipped) of an index run over files (doc_id, by) from its chunks (doc_id)."""
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return files.join(counted, "doc_id", "left").groupBy(by).agg(F.count("_n").alias("files_indexed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks_stored"), F.count_if(F.col("_n").isNull()).alias("files_skipped"))


def fetched(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(cid, status, tries) of remote fetches from their log (cid, attempt, ok): the first success of at most `most` tries, else fetch_failed."""
    w = Window.partitionBy("cid").orderBy("attempt")
    rows = attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    out = rows.groupBy("cid").agg(F.min(F.when(F.col("ok"), F.col("_n"))).alias("_first"), F.max("_n").alias("_last"))
    return out.select("cid", F.when(F.col("_first").isNotNull(), "fetched").otherwise("fetch_failed").alias("status"), F.coalesce("_first", "_last").cast("long").alias("tries"))


def index_remote(content: DataFrame, indexed: DataFrame, least: int, most: int, dimensions: int = 384, embedder: Embedder = vectors.embed) -> DataFrame:
    """Remote content by the same steps, but for what is indexed, of another type or over 100 MiB; broken UTF-8 is mended."""
    fit = content.join(indexed.select("doc_id"), "doc_id", "left_anti").where(strings.indexable(F.col("content_type"), rule="remote") & (F.octet_length("data") <= 100 << 20))
    return index(fit.select("doc_id", F.make_valid_utf8(F.col("data").cast("string")).alias("text")), least, most, dimensions, embedder=embedder)


def rag_context(chunks: DataFrame, by: str, most: int = 5) -> DataFrame:
    """(by, context): the first chunks by rank as numbered sources."""
    top = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).where(F.col("_n") <= most)
    part = F.transform(F.array_sort(F.collect_list(F.struct("_n", "content"))), lambda s: F.concat(F.lit("[Source "), s["_n"].cast("string"), F.lit("]\n"), s["content"], F.lit("\n")))
    return top.groupBy(by).agg(F.array_join(part, "\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context, citing [Source N]; say so if it doesn't hold the answer.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def citations(chunks: DataFrame, by: str, most: int = 5) -> DataFrame:
    return chunks.withColumn("citation", F.row_number().over(Window.partitionBy(by).orderBy("rank")).cast("long")).where(F.col("citation") <= most)


def answers(questions: DataFrame, chunks: DataFrame, by: str = "q", most: int = 5) -> DataFrame:
    """(by, prompt, error) of each question from its retrieved chunks (by, rank, content); one without any is the error NO_CONTEXT."""
    context = rag_context(chunks, by, most)
    out = questions.join(context, by, "left")
    return out.select(by, F.when(F.col("context").isNotNull(), prompt(F.col("question"), F.col("context"))).alias("prompt"), F.when(F.col("context").isNull(), "NO_CONTEXT").alias("error"))


def rerank(chunks: DataFrame, by: str, question: str = "question", most: int = 5, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The best chunks of each question, their rank by score: the share of the question's words that a chunk holds, a stand-in for a cross-encoder (question, content) of the caller's."""
    if score is None:
        asked = F.array_distinct(F.split(F.lower(F.col(question)), r"\W+"))
        value = F.size(F.array_intersect(asked, F.split(F.lower("content"), r"\W+"))) / F.size(asked)
    else:
        value = score(F.col(question), F.col("content"))
    scored = chunks.withColumn("rerank", value)
    w = Window.partitionBy(by).orderBy(F.desc("rerank"), "rank")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def stored_entities(chunks: DataFrame, answer: Column, space_id: Column, created_by: Column, at_least: float = 0.7) -> DataFrame:
    """New entities (doc_id, space_id, entity_type, name, properties, created_by) of a model's answers about chunks (doc_id, source_path, text); blank chunks give none."""
    found = extract_entities(chunks.where(F.length(F.trim("text")) > 0), answer, at_least)
    properties = F.to_json(F.struct("confidence", "source_path"))
    return found.select("doc_id", space_id.alias("space_id"), F.col("type").alias("entity_type"), "name", properties.alias("properties"), created_by.alias("created_by"))


COMMON = 1 << 16  # words that most texts hold, whose numbers are broadcast: a few MB


def keywords(docs: DataFrame, most: int = 5, common: int = COMMON) -> DataFrame:
    """(doc_id, word, tf, place): each text's words of most weight.

    Texts are dealt out by doc_id, so their words are counted where they lie. The most frequent words are weighed there, too,
    and all but each text's first `most` of them are left; the other words meet their numbers by a join.
    """
    dealt = docs.select("doc_id", "text").repartition("doc_id")
    words = dealt.select("doc_id", F.explode(F.split(F.lower("text"), r"\W+")).alias("word")).where(F.length("word") > 3)
    tf = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = files.written(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")), files.shared(docs.sparkSession, "keywords"), "df")  # a row a word, used twice
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    often = df.orderBy(F.desc("df"), "word").limit(common)
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 9)), "word")
    met = tf.join(F.broadcast(often), "word", "left").crossJoin(F.broadcast(total))
    near = met.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", F.col("df").isNull()).orderBy(F.desc(F.round(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 9)), "word")))
    near = near.where(F.col("df").isNull() | (F.col("_r") <= most)).drop("_r")
    rare = near.where("df is null").drop("df").join(df, "word")
    scored = near.where("df is not null").unionByName(rare).withColumn("place", F.row_number().over(order).cast("long"))
    return scored.where(F.col("place") <= most).select("doc_id", "word", "tf", "place")


def extract_entities(chunks: DataFrame, answer: Column, at_least: float = 0.7) -> DataFrame:
    """(…, type, name, confidence) of a model's answers, at the least confidence."""
    return chunks.withColumn("e", F.explode(strings.parse_entities(answer))).select(*chunks.columns, "e.type", "e.name", "e.confidence").where(F.col("confidence") >= at_least)
