"""Nearest neighbours and multi-source search: normalise, penalise, group, boost, rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import vectors
from lodestone.functions.batches import released

PENALTY, BOOST, MOST_BOOST = 0.9, 0.1, 0.3


BLOCK, FEW = 1 << 15, 8  # query vectors that meet the collection in one scan (16 MB of 64 dimensions), and so few that the JVM compares them
AT_ONCE, CELLS = 256, 1 << 19  # query vectors compared at once in a task, and numbers of one matrix of distances
SENT = 1 << 16  # rows of an Arrow batch of what was found


def blocks_of(queries: DataFrame, most: int = BLOCK) -> list[DataFrame]:
    """The queries in blocks of about `most` rows, by hash of their id."""
    n = -(-queries.count() // most)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


class Nearest:
    """The k nearest of each of some queries among rows that come in blocks, ties by id; a row of the query's own id doesn't count.

    Distances count to 12 digits. What is held are k rows a query, so its size doesn't depend on the rows that come.
    """

    def __init__(self, k: int, names: np.ndarray, itself: bool = False):
        self.k, self.names, self.itself = k, names, itself
        self.far, self.ids, self.tags = np.full((len(names), k), np.inf), None, np.zeros((len(names), k), np.int32)

    def add(self, who: np.ndarray, ids: np.ndarray, distance: np.ndarray, tag: int = 0, allowed: np.ndarray | None = None) -> None:
        """distance: (len(who), len(ids)); tag: a number given back with these rows; allowed: which of the pairs count."""
        if self.ids is None:
            self.ids = np.zeros(self.far.shape, ids.dtype)
        keep = distance <= self.far[who, -1:] + 1e-11  # all that may tie with the k-th stay until ids decide
        if allowed is not None:
            keep &= allowed
        if not self.itself:
            keep &= self.names[who][:, None] != ids[None, :]
        if np.count_nonzero(keep) > 4 * self.k * len(who):
            keep &= distance <= np.partition(np.where(keep, distance, np.inf), self.k - 1, axis=1)[:, self.k - 1 : self.k] + 1e-11
        q, j = np.nonzero(keep)
        if not len(q):
            return
        some, q_of = np.unique(q, return_inverse=True)
        at = who[some]
        q = np.concatenate((np.repeat(np.arange(len(some)), self.k), q_of))
        far = np.concatenate((self.far[at].ravel(), np.round(distance[some[q_of], j], 12)))
        found, tags = np.concatenate((self.ids[at].ravel(), ids[j])), np.concatenate((self.tags[at].ravel(), np.full(len(j), tag, np.int32)))
        real = np.isfinite(far)
        q, far, found, tags = q[real], far[real], found[real], tags[real]
        rank = np.unique(found, return_inverse=True)[1] if found.dtype == object else found
        order = np.lexsort((rank, far, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, place = order[place < self.k], place[place < self.k]
        self.far[at] = np.inf
        for held, new in ((self.far, far), (self.ids, found), (self.tags, tags)):
            held[at[q[order]], place] = new[order]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query's id, id, distance, tag) as columns, in blocks."""
        if self.ids is None:
            return
        step = max(1, SENT // self.k)
        for low in range(0, len(self.names), step):
            q, place = np.nonzero(np.isfinite(self.far[low : low + step]))
            if len(q):
                yield self.names[low + q], self.ids[low + q, place], self.far[low + q, place], self.tags[low + q, place]


def column_of(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of ids, as numbers where they are whole numbers without nulls, so that they take eight bytes each."""
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(values, pa.Array) else values.to_numpy().astype(np.int64)
    return np.array(values.to_pylist(), object)


def matrix_of(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def similarities(collection: DataFrame, queries: DataFrame, vector: str = "embedding", id_col: str = "vec_id", most: int = 512) -> DataFrame:
    """(query_id, the collection's columns, score): each row of the collection with its cosine similarity to each query (query_id, vector), but for the row of its own id.

    All pairs, for queries of a checked number; `knn` takes any number.
    """
    n = queries.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} query vectors")
    both = collection.crossJoin(F.broadcast(queries.select("query_id", F.col(vector).alias("_q"))))  # at most `most` rows
    return both.where(F.col(id_col) != F.col("query_id")).withColumn("score", 1.0 - vectors.cosine_distance(F.col(vector), F.col("_q"))).drop("_q")


def ranked(near: DataFrame, k: int, at_most: float | None, id_col: str = "vec_id") -> DataFrame:
    """The k nearest rows of each query. With a threshold 2k are fetched, those within it kept, and k returned."""
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    out = near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= (k if at_most is None else 2 * k))
    return out if at_most is None else out.where((F.col("distance") <= at_most) & (F.col("rank") <= k))


def knn(collection: DataFrame, queries: DataFrame, k: int, at_most: float | None = None, vector: str = "embedding", id_col: str = "vec_id", most: int = BLOCK, itself: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows by cosine distance of each query (query_id, vector), but for the row of its own id; with `itself` that one too.

    A few queries are compared in the JVM. More travel to the collection's partitions, one scan for each 32,768 of them,
    which send on only their own nearest of each query. most: how many are compared at once there.
    """
    fetch, out = k if at_most is None else 2 * k, None
    queries = queries.select("query_id", vector)
    if len(queries.select("query_id").limit(FEW + 1).collect()) <= FEW:
        asked = F.broadcast(queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_q")))  # FEW rows at most
        both = collection.where(F.col(vector).isNotNull()).select(id_col, vector).crossJoin(asked)
        both = both if itself else both.where(F.col(id_col) != F.col("query_id"))
        return ranked(both.select("query_id", id_col, F.round(vectors.cosine_distance(F.col(vector), F.col("_q")), 12).alias("distance")), k, at_most, id_col)
    for block in blocks_of(queries):
        part = _nearest(collection, block, fetch, vector, id_col, itself, most)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, at_most, id_col)


def _nearest(collection: DataFrame, block: DataFrame, k: int, vector: str, id_col: str, itself: bool, most: int, planes: np.ndarray | None = None, within: int = 0) -> DataFrame:
    """(query_id, id, distance) of each query's k nearest in each partition; with planes, of rows whose signs differ in `within` places at most."""
    spark = collection.sparkSession
    schema = block.select("query_id").join(collection.select(id_col)).withColumn("distance", F.lit(0.0)).schema
    rows = block.where(F.col(vector).isNotNull()).toArrow()  # a block's vectors
    if not len(rows):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast((column_of(rows.column(0)), unit(matrix_of(rows.column(1)))))
    fields, most = to_arrow_schema(schema), min(most, AT_ONCE)
    stored = planes is not None and "signature" in collection.columns

    def run(batches):
        names, q = held.value
        top, step = Nearest(k, names, itself), max(1, CELLS // most)
        marks = None if planes is None else signs(q, planes)
        for batch in batches:
            for at in range(0, len(batch), step):
                ids, own = column_of(batch.column(0).slice(at, step)), matrix_of(batch.column(1).slice(at, step))
                if planes is not None:
                    own_marks = column_of(batch.column(2).slice(at, step)) if stored else signs(own, planes)
                own = unit(own).T
                for low in range(0, len(names), most):
                    some = slice(low, min(low + most, len(names)))
                    allowed = None if marks is None else np.bitwise_count(marks[some, None] ^ own_marks) <= within
                    top.add(np.arange(some.start, some.stop), ids, 1.0 - q[some] @ own, allowed=allowed)
        for found in top.rows():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found[:3], fields, strict=True)], schema=fields)

    return collection.where(F.col(vector).isNotNull()).select(id_col, vector, *(["signature"] if stored else [])).mapInArrow(released(run), schema)


def sign_planes(planes: int, dimensions: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.normal(size=dimensions) for _ in range(planes)])


def signs(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The numbers of `signature_bits`."""
    return ((rows @ planes.T >= 0) << np.arange(len(planes))).sum(axis=1).astype(np.int64)


def signature_bits(vector: Column, planes: int, dimensions: int, seed: int = 7) -> Column:
    """Signs of random projections, packed into one number: near vectors share most of them."""
    out = F.lit(0).cast("long")
    for p, plane in enumerate(sign_planes(planes, dimensions, seed)):
        out = out + F.when(vectors.dot(vector, F.array(*(F.lit(float(x)) for x in plane))) >= 0, F.lit(1 << p)).otherwise(0).cast("long")
    return out


def knn_prefiltered(collection: DataFrame, queries: DataFrame, k: int, planes: int = 16, within: int = 9, dimensions: int = 64, most: int = 512) -> DataFrame:
    """(query_id, vec_id, distance, rank): approximate nearest neighbours; only rows whose projections differ in few signs are scored. A stored signature column saves its computation."""
    out = None
    for block in blocks_of(queries.select("query_id", "embedding")):
        near = _nearest(collection, block, k, "embedding", "vec_id", False, most, sign_planes(planes, dimensions), within)
        out = near if out is None else out.unionByName(near)
    return ranked(out, k, None)


def top_per_source(scored: DataFrame, k: int, source: str = "source_id", id_col: str = "vec_id") -> DataFrame:
    order = Window.partitionBy(source).orderBy(F.desc("score"), id_col)
    return scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def normalised(rows: DataFrame) -> DataFrame:
    """Scores from 0 to 1 within each source; 1 where a source's scores are all equal."""
    w = Window.partitionBy("source_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rows.withColumn("norm", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def aggregate(rows: DataFrame, limit: int, penalties: bool = True, boost: bool = True, id_col: str = "vec_id") -> DataFrame:
    """Merges (id, source, source_id, score) rows of several sources.

    A group counts its rows, takes its best penalised score and that row's source (local if any row is), and adds a capped
    boost for each further row. Returns the first `limit` with total_unique and overflow on every row.
    """
    local = F.col("source") == "local"
    scored = normalised(rows).withColumn("pen", F.when(~local & F.lit(penalties), F.col("norm") * PENALTY).otherwise(F.col("norm")))
    grouped = scored.groupBy(id_col).agg(F.count(F.lit(1)).alias("sources_count"), F.max("pen").alias("score"), F.max(local.cast("int")).alias("_local"), F.min(F.struct(-F.col("pen"), "source_id")).alias("_best"))
    extra = F.least(BOOST * (F.col("sources_count") - 1), F.lit(MOST_BOOST)) if boost else F.lit(0.0)
    merged = grouped.select(id_col, "sources_count", "score", (F.col("score") + extra).alias("adjusted_score"), F.when(F.col("_local") == 1, "local").otherwise("network").alias("source"), F.col("_best.source_id").alias("source_id"))
    total = merged.agg(F.count(F.lit(1)).alias("total_unique"))
    top = merged.orderBy(F.desc("adjusted_score"), id_col).limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.col("total_unique") - limit, F.lit(0)).cast("long"))


def federated(rows: DataFrame, k: int, limit: int, id_col: str = "vec_id") -> DataFrame:
    """k of each collection, remote scores penalised as they are, then the best of all."""
    top = top_per_source(rows, k, id_col=id_col)
    adjusted = F.when(F.col("source") == "local", F.col("score")).otherwise(F.col("score") * PENALTY)
    return top.withColumn("adjusted_score", adjusted).orderBy(F.desc("adjusted_score"), id_col, "source_id").limit(limit)


def response_counts(results: DataFrame) -> DataFrame:
    """Counts of one response, after its limit; total_found adds what was cut."""
    local = F.count_if(F.col("source") == "local")
    network = F.count_if(F.col("source") == "network")
    return results.agg(local.alias("local_count"), network.alias("network_count"), F.coalesce(F.max("overflow"), F.lit(0)).alias("more_available")).withColumn("total_found", F.expr("local_count + network_count + more_available"))


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    if scope not in ("local", "network", "all"):
        raise ValueError(f"invalid scope: {scope}")
    return rows if scope == "all" else rows.where(F.col("source") == scope)


def request_error(query: Column, scope: Column, limit: Column, most_bytes: int = 1000, most: int = 100) -> Column:
    """The first error of a request, null if it is valid."""
    return (
        F.when(query.isNull() | (F.length(F.trim(query)) == 0), "EMPTY_QUERY").when(F.octet_length(query) > most_bytes, "QUERY_TOO_LONG")
        .when(~F.lower(F.coalesce(scope, F.lit("all"))).isin("local", "network", "all"), "INVALID_SCOPE").when((limit < 1) | (limit > most), "INVALID_LIMIT")
    )


def query_message_error(query: Column, limit: Column, ts_ms: Column, now_ms: Column, age_ms: int = 60_000) -> Column:
    return F.when((F.octet_length(query) < 1) | (F.octet_length(query) > 1000), "INVALID_QUERY").when((limit < 1) | (limit > 100), "INVALID_LIMIT").when(ts_ms < now_ms - age_ms, "EXPIRED")


def answerable(messages: DataFrame, me: Column, enabled: bool, most: int) -> DataFrame:
    """Queries that this node answers: opted in, valid, not its own; the limit is the smaller one."""
    fit = F.col("error").isNull() & (F.col("peer") != me) & F.lit(enabled)
    return messages.where(fit).withColumn("limit", F.least("limit", F.lit(most)))
