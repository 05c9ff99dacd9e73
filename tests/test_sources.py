"""Nested ignore files, files of frames, summaries, and a registry of providers."""

import json
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import summaries
from lodestone.sources import files, frames


def test_nested_ignore_files(spark, tmp_path):
    made = {
        ".gitignore": "*.log\n!keep.log\n/top.txt\nbuild/\ndocs/*\n!docs/in.md\n", "a.log": "", "keep.log": "", "top.txt": "", "sub/top.txt": "", "build/x.md": "", "sub/build/y.md": "", "docs/in.md": "", "docs/out.md": "",
        "sub/.gitignore": "!a.log\nkeep.log\n!build/\nonly/**\n", "sub/a.log": "", "sub/keep.log": "", "sub/deep/keep.log": "", "sub/only/z.md": "", "sub/deep/.gitignore": "# none\n!keep.log\n?.md\n", "sub/deep/b.md": "", "sub/deep/bb.md": "",
        "gone/.gitignore": "*\n", "gone/a.md": "", "gone/sub/b.md": "", "back/.gitignore": "*\n!.gitignore\n!*.md\n", "back/c.md": "", "back/d.txt": "",
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x")
    got = {r.path.split(f"{tmp_path}/")[1] for r in files.scan(spark, str(tmp_path)).select("path").collect()}
    assert got == {"keep.log", "sub/top.txt", "sub/build/y.md", "docs/in.md", "sub/a.log", "sub/deep/keep.log", "sub/deep/bb.md", "back/c.md"}
    assert "a.log" in {r.path.split(f"{tmp_path}/")[1] for r in files.scan(spark, str(tmp_path), ignore_file=None).collect()}
    assert {r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), ["md"], ignored=["y.md"]).collect()} == {"c.md", "in.md", "bb.md"}


@pytest.fixture(scope="module")
def register(spark):
    spark.dataSource.register(frames.Frames)


def test_frames(spark, register, tmp_path):
    """10^5 frames in one file read in several parts; they come back whole, and as Variants."""
    rng, bodies = random.Random(1), []
    for i in range(100_000):
        value = {"i": i, "t": "é" * rng.randrange(8), "l": [1.5, None, True], "n": -i}
        bodies.append(json.dumps(value).encode() if i % 3 == 0 else files.cbor_encode(value))
    bodies[7] = b"\xff\xff"
    (tmp_path / "one.frames").write_bytes(b"".join(struct.pack(">I", len(b)) + b for b in bodies))
    read = spark.read.format("lodestone_frames").option("part", str(1 << 20)).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    ints = read.select("offset", "size", F.try_variant_get(F.parse_json("message"), "$.i", "long").alias("i"), F.try_variant_get(F.parse_json("message"), "$.n", "long").alias("n"))
    got = ints.orderBy("offset").collect()
    assert [r.i for r in got] == [None if i == 7 else i for i in range(100_000)] and all(r.n is None or r.n == -r.i for r in got)
    assert [r.size for r in got] == [len(b) for b in bodies]
    out = str(tmp_path / "out")
    read.where("message is not null").select("message").repartition(4).write.format("lodestone_frames").mode("append").save(out)
    again = spark.read.format("lodestone_frames").load(out)
    assert again.select(F.count(F.lit(1)), F.sum(F.xxhash64("message").cast("decimal(38,0)"))).first() == read.where("message is not null").select(F.count(F.lit(1)), F.sum(F.xxhash64("message").cast("decimal(38,0)"))).first()
    again.limit(3).select("message").write.format("lodestone_frames").mode("overwrite").save(out + "2")
    assert spark.read.format("lodestone_frames").load(out + "2").count() == 3


@pytest.mark.parametrize(("data", "part", "error"), [(b"\0\0\0\0", 1 << 20, "bad frame of 0 bytes"), (struct.pack(">I", 99) + b"x" * 99, 1 << 20, "bad frame of 99 bytes"), (struct.pack(">I", 9) + b"x", 1 << 20, "ends within a frame"), (b"\0\0", 1 << 20, "ends within a frame"), (struct.pack(">I", 9) + b"x", 1, "ends within a frame"), (b"\0\0\0\0", 1, "bad frame of 0 bytes")])
def test_bad_frames(spark, register, tmp_path, data, part, error):
    (tmp_path / "f").write_bytes(data)
    with pytest.raises(Exception, match=error):
        spark.read.format("lodestone_frames").options(most="50", part=str(part)).load(str(tmp_path)).collect()


def test_no_frames(spark, register, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    assert spark.read.format("lodestone_frames").load(str(tmp_path)).count() == 0


def test_ranks_without_pairs():
    """The same ranks as a matrix of all pairs gives."""
    rng = random.Random(2)
    words = [sorted({f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))}) for _ in range(25)] + [["alone"]]
    a = np.array([[w in own for w in sorted({*sum(words, [])})] for own in words], float)
    a /= np.sqrt(a.sum(axis=1, keepdims=True))
    near = a @ a.T
    np.fill_diagonal(near, 0)
    degree = near.sum(axis=1)
    rank = np.full(len(words), 1 / len(words))
    for _ in range(5):
        rank = 0.15 / len(words) + 0.85 * near @ np.divide(rank, degree, out=np.zeros_like(rank), where=degree > 1e-12)
    assert np.allclose(summaries.ranks(words, 5), rank)


def test_summaries(spark):
    text = "Cats chase small mice. Dogs chase cats! Nothing here\nSmall mice fear cats and dogs chase mice. ok no. Rain falls"
    df = spark.createDataFrame([(1, text), (2, None), (3, "a b c"), (4, "One word")], "doc_id long, text string")
    got = {r.doc_id: (r.summary, r.sentences) for r in summaries.summarised(df, 2).collect()}
    assert got[2] == got[3] == ("", 0) and got[4] == ("One word", 1)
    best, n = got[1]
    assert n == 5 and best in text.replace("\n", " ").replace(". ", " ").replace("! ", " ") or all(p in text for p in re.split(" (?=[A-Z])", best))
    assert "Small mice fear cats and dogs chase mice" in best
