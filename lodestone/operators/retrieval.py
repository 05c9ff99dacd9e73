"""Answers by retrieval: sub-questions, one search for all of them, fused lists, reranked chunks, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.extensions import Embedder
from lodestone.functions import vectors
from lodestone.operators import indexing, search

SPLIT = r"[.?!;\n]+"  # where a question is cut, unless the caller's own splitter (a model's) makes the parts
CONSTANT = 60.0  # of reciprocal rank fusion: how little the first places of one list outweigh the next


def subquestions(questions: DataFrame, splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(q, part, asked): the whole question as part 0, then its distinct sentences of two words or more where it has several. splitter: a question to an array of texts."""
    parts = splitter(F.col("question")) if splitter else F.split("question", SPLIT)
    parts = F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.contains(" ")))
    every = F.when(F.size(parts) > 1, F.concat(F.array("question"), parts)).otherwise(F.array("question"))
    return questions.where(F.length(F.trim("question")) > 0).select("q", F.posexplode(every).alias("part", "asked"))


def fused(lists: DataFrame, most: int, by: str = "q", item: str = "chunk_id", constant: float = CONSTANT) -> DataFrame:
    """(by, item, fused, rank): ranked lists (by, item, rank) of each question as one, by the sum of reciprocal ranks; the first `most`."""
    from pyspark.sql import Window

    total = lists.groupBy(by, item).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("fused"))
    order = Window.partitionBy(by).orderBy(F.desc("fused"), item)
    return total.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def retrieved(questions: DataFrame, chunks: DataFrame, each: int = 20, most: int = 20, dimensions: int = 384, embedder: Embedder = vectors.embed, splitter: Callable[[Column], Column] | None = None, nearest: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(q, chunk_id, fused, rank): for each question (q, question) the chunks (chunk_id, embedding) nearest to its parts, fused.

    nearest: (queries, k) to (query_id, chunk_id, rank), such as an index's search; by default all chunks are compared.
    Questions and chunks meet as vectors and ids alone.
    """
    parts = subquestions(questions, splitter)
    asked = parts.select(F.struct("q", "part").alias("_key"), embedder(F.col("asked"), dimensions).alias("embedding"))
    asked = asked.select(F.to_json("_key").alias("query_id"), F.col("_key.q").alias("q"), "embedding")
    queries = asked.select("query_id", "embedding")
    near = nearest(queries, each) if nearest else search.knn(chunks, queries, each, id_col="chunk_id", itself=True)
    return fused(near.join(asked.select("query_id", "q"), "query_id").select("q", "chunk_id", "rank"), most)


def answered(questions: DataFrame, chunks: DataFrame, each: int = 20, most: int = 20, sources: int = 5, score: Callable[[Column, Column], Column] | None = None, **options) -> DataFrame:
    """(q, prompt, sources, error): retrieval, reranking to `sources` chunks (chunk_id, chunk, embedding), and the prompt for an answer that cites them; a question without any is the error NO_CONTEXT.

    Texts are fetched for the fused chunks alone, `most` a question.
    """
    top = retrieved(questions, chunks, each, most, **options)
    texts = chunks.select("chunk_id", F.col("chunk").alias("content")).join(top, "chunk_id")
    best = indexing.rerank(texts.join(questions, "q"), "q", most=sources, score=score)
    cited = best.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("sources"))
    return indexing.answers(questions, best, "q", sources).join(cited, "q", "left").select("q", "prompt", "sources", "error")
