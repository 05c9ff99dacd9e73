"""Partial failure, caches in front of searches, providers and key-value tables."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone import extensions
from lodestone.operators import blocks, federation


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>").cache()


class Failing(federation.Table):
    def search(self, query, limit):
        return super().search(query, limit).withColumn("score", F.raise_error(F.lit("out of order")).cast("double"))


class Sick(federation.Table):
    def health(self):
        return "no disk"


class Slow(federation.Table):
    def search(self, query, limit):
        time.sleep(30)
        raise AssertionError


class Raising(federation.Table):
    def health(self):
        raise OSError("unreachable")


def asked(vectors, *numbers):
    return vectors.where(F.col("vec_id").isin(*numbers)).select(F.col("vec_id").alias("query_id"), "embedding")


def test_one_failing_source_costs_its_own_rows(spark, vectors):
    made = lambda kind, name, scope="network": kind(vectors, name, scope)
    adapters = [made(federation.Table, "a", "local"), made(Failing, "b"), made(Sick, "c"), made(Slow, "d"), made(Raising, "e")]
    began = time.time()
    rows, status = federation.searched(adapters, asked(vectors, 3), 5, timeout_s=12)
    assert time.time() - began < 28
    got = {r.adapter: (r.status, r.rows) for r in status.collect()}
    assert got == {"a": ("ok", 5), "b": ("failed", 0), "c": ("unhealthy", 0), "d": ("timeout", 0), "e": ("failed", 0)}
    assert {r.source_id for r in rows.collect()} == {"a"} and rows.count() == 5
    assert "unreachable" in status.where("adapter = 'e'").first().error
    with pytest.raises(RuntimeError, match="c: unhealthy, no disk"):
        federation.searched(adapters[1:3], asked(vectors, 3), 5, timeout_s=60)
    with pytest.raises(ValueError, match="no adapter"):
        federation.searched(adapters[1:3], asked(vectors, 3), 5, scope="local")
    assert all(isinstance(a, extensions.SearchAdapter) for a in adapters)


class Counting(federation.Table):
    asked = 0

    def search(self, query, limit):
        type(self).asked += query.count()
        return super().search(query, limit)


def test_cache(spark, vectors, tmp_path):
    """Equal questions are searched for once, answers expire, another cache on the same path sees them, and trimming keeps the last."""
    cache, table = federation.SearchCache(spark, str(tmp_path / "c"), ttl_ms=100, capacity=1), Counting(vectors, "a")
    batch = lambda *ns: asked(vectors, *ns).withColumn("query", F.concat(F.lit("q"), (F.col("query_id") % 30).cast("string"))).withColumn("scope", F.lit("all"))
    rows, hits = cache.through(table, batch(1, 2, 31), 4, 10)
    assert {(r.query_id, r.hit) for r in hits.collect()} == {(1, False), (2, False), (31, False)} and Counting.asked == 2
    assert sorted((r.query_id, r.vec_id) for r in rows.collect() if r.query_id == 31) == sorted((31, r.vec_id) for r in rows.collect() if r.query_id == 1)
    again = federation.SearchCache(spark, str(tmp_path / "c"), ttl_ms=100, capacity=1)
    rows, hits = again.through(table, batch(2, 3), 4, 60)
    assert {(r.query_id, r.hit) for r in hits.collect()} == {(2, True), (3, False)} and Counting.asked == 3 and rows.count() == 8
    _, hits = again.through(table, batch(2, 3), 4, 115)
    assert {(r.query_id, r.hit) for r in hits.collect()} == {(2, False), (3, True)} and Counting.asked == 4
    _, hits = again.through(table, batch(2), 5, 116)
    assert not hits.first().hit  # another limit
    assert again.trim(117) == 1
    rows, hits = again.through(table, batch(2), 5, 118)
    assert hits.first().hit and rows.count() == 5
    assert not again.through(table, batch(3), 4, 119)[1].first().hit


def test_providers(spark):
    held = lambda rows: spark.createDataFrame(rows, "cid string, provider string")
    near, far = federation.Holders(held([("x", "p1"), ("y", "p2"), ("x", "p0")])), federation.Holders(held([("x", "q"), ("z", "q")]), rank=100)
    assert isinstance(near, extensions.ContentProvider)
    wanted = held([("x", ""), ("z", ""), ("w", ""), ("l", "")]).select("cid")
    got = blocks.waterfall(wanted, held([("l", "")]).select("cid"), federation.offered([near, far], wanted))
    assert {tuple(r) for r in got.collect()} == {("x", "p0", 1), ("z", "q", 1), ("w", "not_found", 0), ("l", "local", 0)}


def test_kv(spark, tmp_path):
    kv = federation.ParquetKv(spark, str(tmp_path / "kv"))
    assert isinstance(kv, extensions.KvStore) and kv.view().count() == 0
    change = lambda rows: spark.createDataFrame(rows, "key string, value string, at long, deleted boolean")
    kv.apply(change([("a", "1", 1, False), ("b", "1", 1, False), ("a", "2", 2, False)]))
    kv.apply(change([("b", None, 3, True), ("c", "3", 3, False)]))
    assert {(r.key, bytes(r.value)) for r in federation.ParquetKv(spark, str(tmp_path / "kv")).view().collect()} == {("a", b"2"), ("c", b"3")}
