"""Queries on tables made to be larger, or odder, than the test tables: rows repeated under shifted keys."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from lodestone import catalogue


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a query over given tables, and its SQL; the rows of both, sorted."""

    def run(name: str, **tables):
        con = duckdb.connect()
        con.execute("set TimeZone = 'UTC'")
        for table, rows in tables.items():
            rows.write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        got = catalogue.queries()[name](spark, str(tmp_path))
        wanted = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in got.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect())), sorted(wanted)

    return run


def events_of(spark, rows):
    """Events (event_id, seconds, user_id, event_type, value)."""
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + datetime.timedelta(seconds=s), u, kind, float(v), f'{{"k": {i % 90}}}') for i, s, u, kind, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_message_store_with_ids_beyond_a_hundred_thousand(spark, against_sql):
    ids = [i + copy * 100_000 for copy in range(4) for i in (0, 1, 2, 4000, 4001, 8003)]
    got, wanted = against_sql("message_store", events=events_of(spark, [(i, i % 100_000 % 4000 * 7, i % 5, "click", 1) for i in ids]))
    assert got == wanted


def test_frames_of_tasks_without_rows(spark, tmp_path):
    from lodestone.sources.frames import Frames

    spark.dataSource.register(Frames)
    rows = spark.range(3).selectExpr("""'{"k":' || id || '}' message""").repartitionByRange(3, "message").unionByName(spark.range(5, numPartitions=5).where("id < 0").selectExpr("'' message"))
    for rows_, n in ((rows, 3), (rows.where("false"), 3)):
        rows_.write.format(Frames.name()).mode("append").save(str(tmp_path / "out"))
        assert spark.read.format(Frames.name()).load(str(tmp_path / "out")).count() == n
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def vectors_of(spark, n: int, d: int = 8):
    import numpy as np

    rows = np.random.default_rng(3).normal(size=(n, d))
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)


def test_searches_scan_the_collection_once_however_many_blocks_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone.operators import search

    _, rows = vectors_of(spark, 90)
    queries = rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    scans, real = [], search._nearest
    monkeypatch.setattr(search, "_nearest", lambda *a, **kw: scans.append(1) or real(*a, **kw))
    few = sorted(map(tuple, search.knn(rows, queries, 4, most=2).collect()))
    assert len(scans) == 1 and few == sorted(map(tuple, search.knn(rows, queries, 4).collect()))
    near = search.knn_prefiltered(rows, queries, 4, planes=6, within=3, dimensions=8, most=2)
    assert len(scans) == 3
    signed = rows.withColumn("signature", search.signature_bits(F.col("embedding"), 6, 8))
    both = signed.crossJoin(signed.select(F.col("vec_id").alias("query_id"), F.col("signature").alias("s"), F.col("embedding").alias("q")).where("query_id % 3 = 0"))
    from lodestone.functions import vectors

    close = both.where("query_id <> vec_id and bit_count(signature ^ s) <= 3").select("query_id", "vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("q")), 12).alias("distance"))
    wanted = sorted(map(tuple, search.ranked(close, 4, None).select("query_id", "vec_id", "rank").collect()))
    assert sorted(map(tuple, near.select("query_id", "vec_id", "rank").collect())) == wanted
    assert sorted(map(tuple, search.knn_prefiltered(signed, queries, 4, planes=6, within=3, dimensions=8).select("query_id", "vec_id", "rank").collect())) == wanted


def test_nearest_holds_k_rows_a_query():
    import numpy as np

    from lodestone.operators.search import Nearest

    rng = np.random.default_rng(5)
    far = np.round(rng.random((6, 4000)), 2)  # many ties
    ids = rng.permutation(4000)
    top = Nearest(5, np.array([ids[0], -1, -2, -3, -4, -5]))
    for at in range(0, 4000, 700):
        top.add(np.arange(6), ids[at : at + 700], far[:, at : at + 700], at)
        assert top.far.shape == top.ids.shape == top.tags.shape == (6, 5)
    got = {}
    for who, found, distance, _ in top.rows():
        for w, i, d in zip(who.tolist(), found.tolist(), distance.tolist(), strict=True):
            got.setdefault(w, []).append((d, i))
    for row, name in enumerate(top.names.tolist()):
        assert got[name] == sorted((d, i) for d, i in zip(far[row].tolist(), ids.tolist(), strict=True) if i != name)[:5]


def test_cells_of_an_index_are_the_means_of_all_rows(spark, tmp_path):
    import hashlib

    import numpy as np

    from lodestone.operators import ann

    held, rows = vectors_of(spark, 120)
    index = ann.VectorIndex.create(rows, str(tmp_path / "index"), cells=4, subspaces=2, rounds=2, sample=20)
    order = sorted(range(120), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert np.allclose(index.model.centroids, ann.spherical_means(ann.unit(held[order]), 4, 2))


def test_keywords_by_broadcast_and_joined_words(spark):
    from lodestone.operators import indexing

    docs = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 17:02d}" for k in range(1, 30)) + " alone" * (i % 3) + f" own{i:03d}") for i in range(40)] + [(3, "word01 again again"), (50, None)], "doc_id long, text string")
    wanted = sorted(map(tuple, indexing.keywords(docs).collect()))
    assert {r[0] for r in wanted} == set(range(40))
    for common in (0, 1, 7):
        assert sorted(map(tuple, indexing.keywords(docs, common=common).collect())) == wanted


def test_rows_of_a_key_are_taken_in_order_without_frames_of_their_own():
    import pandas as pd

    from lodestone.streaming.timers import taken

    parts = [pd.DataFrame({"key": ["a", "a"], "ts_ms": [5, 3], "id": [1, 9], "kind": ["query", "answer"]}), pd.DataFrame({"key": ["a"], "ts_ms": [3], "id": [2], "kind": ["answer"]})]
    assert taken(iter(parts), "kind") == [(3, 2, "answer"), (3, 9, "answer"), (5, 1, "query")]


def test_fingerprints_of_many_texts_are_made_together(monkeypatch):
    """Long, short and uniform texts, also with blocks that end within a chunk; the byte-by-byte steps are no part of it."""
    import numpy as np

    from lodestone.functions import chunking

    rng = np.random.default_rng(1)
    texts = [rng.integers(0, k, n).astype(np.uint8).tobytes() for n in (0, 1, 64, 129, 1024, 1025, 5000, 40000) for k in (2, 60, 256)] + [bytes(20000), b"ab" * 9000]
    for sizes in (chunking.SMALL, chunking.Sizes(64, 256, 1000), chunking.Sizes(64, 64, 64)):
        wanted = [chunking.Rabin(sizes).cuts_plain(x) for x in texts]
        for at_once in (5000, 1 << 20):
            with monkeypatch.context() as m:
                m.setattr(chunking, "AT_ONCE", at_once)
                m.setattr(chunking.Rabin, "cuts_plain", None)
                assert chunking.Rabin(sizes).cuts_of(texts) == wanted


class Handed:
    """Takes a DataFrame's place and keeps the function that its tasks would run."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_packed_texts_are_sent_on_in_pieces():
    """A batch of 8 MB gives batches of about 1 MB, all chunks in order."""
    import pyarrow as pa

    from lodestone.functions import chunking

    texts = [f"{i} " + "word " * 400 + "\n\n" + "other " * 100 for i in range(3000)] + [None, "", "x" * 3_000_000, "end of it all"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(chunking.packed(Handed(), 5, 1000)(iter([batch])))
    assert len(out) > 7 and sorted(b.nbytes for b in out)[-2] < 1_500_000
    got = [(r["doc_id"], r["idx"], r["chunk"]) for b in out for r in b.to_pylist()]
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.paragraphs(t or "", 5, 1000))]


def test_embedders_give_a_vector_a_row_over_several_slices(spark):
    from lodestone.functions import vectors

    texts = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"Word{i % 40} two  Word{i % 3}") for i in range(2500)]
    rows = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    for embedder in (vectors.embed, vectors.word_counts):
        got = {r.id: tuple(r.v) for r in rows.select("id", embedder("text", 16).alias("v")).collect()}
        one = {r.text: tuple(r.v) for r in rows.dropDuplicates(["text"]).repartition(50).select("text", embedder("text", 16).alias("v")).collect()}
        assert len(got) == 2500 and all(got[i] == one[t] and len(got[i]) == 16 for i, t in texts)


def test_vectors_are_put_into_cells_in_slices(spark, tmp_path):
    """However long a batch is, rows meet the codebooks some at a time; the cells and codes are those of all at once."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import ann

    held = np.random.default_rng(5).normal(size=(1500, 8))
    index = ann.VectorIndex(spark, str(tmp_path / "i"), ann.Model.fit(held, 4, 2, 2, 0.9), "bigint")
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(held.tolist(), pa.list_(pa.float32()))], ["id", "embedding"])
    out = list(index._assigned(Handed())(iter([batch])))
    assert max(map(len, out)) <= ann.AT_ONCE
    own = ann.unit(held.astype(np.float32).astype(float))
    assert np.concatenate([b.column(3).to_numpy() for b in out]).tolist() == ann.cells_of(own, index.model.centroids).tolist()
    assert [c for b in out for c in b.column(2).to_pylist()] == [c.tobytes() for c in index.model.codes(own)]


def test_gather_stop_with_nulls_and_many_keys_a_bucket(spark, against_sql, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone.streaming import timers

    monkeypatch.setattr(timers.gathered, "__defaults__", (*timers.gathered.__defaults__[:-1], 2))  # buckets
    kinds = ["signup", "click", "view", None, "error", "click", "signup"]
    rows = events_of(spark, [(i, i * 977 % 400_000, i % 41, kinds[i % 7], 1) for i in range(1500)])
    odd = lambda c, n: F.when((F.col("event_id") % n != 0) | (F.col("event_type") == "signup"), F.col(c)).alias(c)
    got, wanted = against_sql("stream_gather_stop", events=rows.select(odd("event_id", 19), odd("ts", 23), odd("user_id", 29), "event_type", "value", "props"))
    assert got == wanted and len({r[0] for r in got}) > 100
