"""Stored vector indexes against brute force, one-pass neighbours, and retrieval with sub-questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import indexing, retrieval, search
from lodestone.operators.ann import Model, VectorIndex, probes_for, unit
from lodestone.sources import files

FOLDER = "/root/testdata/sf0.1"


def pairs(df, id_col="vec_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r[id_col])
    return out


def recall(found, want):
    return sum(len(found.get(q, set()) & w) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 60 centres."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.25 * rng.normal(size=32)).astype(float).tolist()) for i in range(3000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def test_index_reads_few_cells(spark, clustered, tmp_path):
    index = VectorIndex.create(clustered, str(tmp_path / "index"), cells=48)
    index.add(clustered)
    assert index.flush() == 3000 and len(index) == 3000
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    queries = clustered.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = pairs(search.knn(clustered, queries, 10))
    assert index.model.probes < 12  # a quarter of the cells
    assert recall(pairs(index.search(queries, 10), "id"), want) >= 0.9
    assert recall(pairs(index.search(queries, 10, shortlist=100), "id"), want) >= 0.9
    one = queries.where("query_id = 0")
    plan = index.search(one, 10, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") or "cell#" in plan.split("PartitionFilters")[1][:120]
    assert len({r.cell for r in index.rows().select("cell").distinct().collect()}) > 12


def test_probes_follow_the_data(spark, tmp_path):
    """Vectors without clusters need most cells for the same recall; the model finds that out by itself."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    index = VectorIndex.create(rows, str(tmp_path / "index"), cells=24)
    index.add(rows)
    index.flush()
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert recall(pairs(index.search(queries, 10), "id"), pairs(search.knn(rows, queries, 10))) >= 0.88
    rng = np.random.default_rng(0)
    flat = unit(rng.normal(size=(500, 8)))
    assert probes_for(flat, flat[:20], 1.0) > probes_for(flat, flat[:20], 0.5)
    assert Model.fit(flat, 20, 4, 2, 0.9).codes(flat).shape == (500, 4)


def test_first_write_wins(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    path = str(tmp_path / "index")
    index = VectorIndex.create(df([("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), path, cells=2)
    index.add(df([("a", [1.0, 0.0]), ("z", [0.0, 0.0])]))
    index.add(df([("a", [0.5, 0.5]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])]))
    assert len(index) == 0 and index.flush() == 3 and index.flush() == 0
    index.add(df([("a", [9.0, 9.0]), ("c", [1.0, 1.0])]))
    assert index.flush() == 1
    index = VectorIndex.load(spark, path)
    assert {r.id: r.embedding for r in index.rows().collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0], "z": [0.0, 0.0]}
    assert {tuple(r) for r in index.contains(df([("a", None), ("q", None)])).collect()} == {("a", True), ("q", False)}
    asked = df([("a", [1.0, 0.0])]).withColumnRenamed("vec_id", "query_id")
    assert [(r.id, round(r.distance, 6), r["rank"]) for r in index.search(asked, 5, probes=2).orderBy("rank").collect()] == [("c", 0.292893, 1), ("b", 1.0, 2), ("z", 1.0, 3)]
    assert index.search(asked, 5, probes=2, itself=True).orderBy("rank").first().id == "a"
    assert index.search(asked.where("false"), 5).count() == 0
    index.add(df([("d", [1.0])]))
    with pytest.raises(Exception, match="expected dimension 2"):
        index.flush()
    assert "flush=2" not in files.names(spark, f"{path}/vectors")
    with files.locked(spark, f"{path}/_writer"):  # a second writer
        with pytest.raises(RuntimeError, match="another writer"):
            index.flush()


def test_generations_are_claimed(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([("space-1-idx", "c", 0, 1.0)], "collection string, cid string, chunk_index int, v double")
    assert files.upsert_vectors(rows, path) == 0
    assert files.claimed(spark, f"{path}/_claims/1") and not files.claimed(spark, f"{path}/_claims/1")  # another writer is at work
    assert files.upsert_vectors(rows.withColumn("v", F.lit(2.0)), path) == 2
    assert [r.v for r in files.vectors(spark, path).collect()] == [2.0]


def test_knn_forms_agree(spark):
    """Few queries in the JVM, many in blocks: ties by id, text ids, null vectors, own ids."""
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03d}", None if i % 17 == 0 else [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding").where("vec_id < 'v030'")
    few = queries.where("query_id < 'v008'")
    for at_most, itself in ((None, False), (0.5, False), (None, True)):
        many = {tuple(r) for r in search.knn(df, queries, 5, at_most, most=7, itself=itself).collect()}
        assert {tuple(r) for r in search.knn(df, few, 5, at_most, itself=itself).collect()} == {r for r in many if r[0] < "v008"}
    near = np.array([v for _, v in rows if v is not None], float)
    ids = [i for i, v in rows if v is not None]
    with np.errstate(all="ignore"):
        own = np.array(rows[1][1])
        scale = np.sqrt((near * near).sum(1)) * np.sqrt((own * own).sum())
        far = np.round(np.where(scale == 0, 1.0, 1 - near @ own / scale), 12)
    want = [i for _, i in sorted((d, i) for d, i in zip(far, ids, strict=True) if i != "v001")[:5]]
    assert [r.vec_id for r in search.knn(df, queries, 5, most=7).where("query_id = 'v001'").orderBy("rank").collect()] == want


def test_subquestions(spark):
    df = spark.createDataFrame([(1, "Who wrote it? When was it. When was it"), (2, "one two"), (3, "  "), (4, None)], "q int, question string")
    got = [(r.q, r.part, r.asked) for r in retrieval.subquestions(df).orderBy("q", "part").collect()]
    assert got == [(1, 0, "Who wrote it? When was it. When was it"), (1, 1, "Who wrote it"), (1, 2, "When was it"), (2, 0, "one two")]


def test_answers_over_an_index(spark, tmp_path):
    """The index in place of the comparison of all chunks; questions without an answer; texts fetched after the fusion alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    chunks = indexing.index(docs, 50, 1000, 32, embedder=vectors.word_counts).select((F.col("doc_id") * 1048576 + F.col("chunk_index")).alias("chunk_id"), "chunk", "embedding").cache()
    index = VectorIndex.create(chunks, str(tmp_path / "index"), cells=8, id_col="chunk_id")
    index.add(chunks, id_col="chunk_id")
    index.flush()
    asked = spark.createDataFrame([(1, chunks.first().chunk), (2, " ")], "q int, question string")
    nearest = lambda q, k: index.search(q, k, probes=8).withColumnRenamed("id", "chunk_id")
    got, want = ({r.q: r for r in retrieval.answered(asked, chunks, dimensions=32, embedder=vectors.word_counts, nearest=n).collect()} for n in (nearest, None))
    assert got == want and got[2].error == "NO_CONTEXT" and got[1].error is None and len(got[1].sources) == 5
    assert chunks.first().chunk_id in got[1].sources and "[Source 5]" in got[1].prompt
