"""Null and repeated ids, repeated rows, nulls in every column, empty tables, and extra columns with the operators' own names: defined results, no crash."""

import hashlib
import random
import zlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, factors, fingerprint, html, jaccard, prefixes, quality, repeats, secrets, sharding, spelling, tokencount

CLASHES = [
    "key", "_key", "rep", "n", "sig", "hub", "lot", "component", "held", "tag", "digest", "size", "anchor", "score", "predicted", "shard", "slot", "crc", "node", "place", "label", "bucket", "copy",
    "batch", "sketch", "rows", "row", "content", "count", "_bit", "_word", "text_crc32", "spans", "item_id", "distance", "word", "bit",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(n))
    base, long = say(60), say(20_000)
    rows = [(1, base), (1, base), (1, base), (2, base + " tail"), (2, say(30)), (None, base), (None, None), (None, say(12)), (None, say(12)), (3, None), (3, ""), (4, "  \n"), (5, long), (6, long), (7, "x"), (7, "x")]
    rows += [(8, 'password = "hunter2hunter2" ' + say(9)), (None, "AKIA" + "A1" * 10)]
    return [(i, t, None if k % 2 else "en", None if k % 3 else "s", None if k % 4 else len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(made(), COLUMNS)
    return df.selectExpr("*", *(f"cast(1 as int) as `{c}`" for c in CLASHES))


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, None), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "some words that nobody else has said before at all"), (1, "x y z w and so on"), (None, "another one here"), (2, None)], "item_id long, text string")


PER_ROW = {
    "quality": lambda d, labels: quality.classify(d, labels),
    "repeats": lambda d, _: repeats.remove(d),
    "bpe": lambda d, _: bpe.digests(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "fingerprint": lambda d, _: fingerprint.compare_edits(d),
    "secrets": lambda d, _: secrets.scan(d),
    "tokens": lambda d, _: tokencount.count_tokens(d, P.path("word_bpe_49k.json")),
    "shards": lambda d, _: sharding.shard(d, 3),
    "jaccard": lambda d, _: jaccard.join(d),
    "factors": lambda d, _: factors.remove(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_each(awkward, nothing, labels, name):
    rows = made()
    got = PER_ROW[name](awkward, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert PER_ROW[name](nothing, labels).count() == 0


def test_values(awkward, labels):
    rows = made()
    kept = [(r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove(awkward).collect()]
    base = len(rows[0][1].encode())
    assert kept.count((1, base, 0)) == 3 and kept.count((None, base, base)) == 1 and kept.count((None, 0, 0)) == 1
    assert (6, len(rows[12][1].encode()), len(rows[12][1].encode())) in kept
    crcs = sorted((str(r.doc_id), r.text_crc32) for r in sharding.shard(awkward, 3).collect())
    assert crcs == sorted((str(i), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    linked = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(awkward).collect()}
    assert {(1, 56, 1), (2, 57, 1), (None, 56, 1), (6, 19_996, 5)} <= {(a, b, c) for a, b, c in linked} and (None, 0, None) in linked
    tokens = [(r.doc_id, r.decoded_sha256) for r in bpe.digests(awkward, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()]
    assert sorted(map(str, tokens)) == sorted(str((i, hashlib.sha256((t or "").encode()).hexdigest())) for i, t, *_ in rows)


def test_decontamination(awkward, nothing, benchmark):
    assert decontaminate.find(awkward, benchmark).count() == 0 and decontaminate.find(nothing, benchmark).count() == 0
    assert decontaminate.clean(awkward, benchmark).columns == awkward.columns and decontaminate.clean(awkward, benchmark).count() == len(made())
    assert decontaminate.clean(awkward, benchmark.where("false")).count() == len(made())


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>One</p>"), (1, "http://a.example/", "<p>One</p>"), (None, None, None), (2, "", ""), (3, "http://a.example/", "<article>" + "<p>w</p>" * 4000)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", *(f"1 as `{c}`" for c in [*CLASHES, "host", "form", "skeleton", "leads", "nodes", "texts", "digests", "places", "lots", "semantic", "fixed"]))
    got = sorted((str(r.page_id), r.n_chars) for r in html.extract(pages).collect())
    assert got == [("1", 3), ("1", 3), ("2", 0), ("3", 4000 * 2 - 1), ("None", 0)]
    assert html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, awkward, nothing, name, tmp_path, labels, benchmark):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, str(tmp_path))
    rows = out.collect()
    if name != "encoding":
        assert out.columns == awkward.columns
    assert stage(spark, nothing, str(tmp_path)).count() == 0
    if name == "near_copies":  # one of each group: the rows of id 2 are one node, linked with the base
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "4", "5", "7", "8", "None", "None", "None", "None"])
    elif name != "quality_classifier":
        assert len(rows) == len(made())


def test_words_and_conversations(spark, awkward, nothing):
    """Repeated rows count each time, null ids are the empty string; conversations without an id are left out, others keep repeated and null turns."""
    rows = made()
    got = {r.word: r.n for r in spelling.variants(awkward).collect()}
    assert got and all(len(w) >= 5 and n >= 3 for w, n in got.items()) and got["alpha"] <= sum((t or "").count("alpha") for _, t, *_ in rows)
    assert spelling.variants(nothing).count() == 0
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "a"), (2, 5, "user", ""), (2, 5, "", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"1 as `{c}`" for c in [*CLASHES, "path", "sizes", "range", "step", "members", "depth", "base", "h"]))
    nodes = prefixes.trie(prefixes.turns(df)).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in nodes) == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 2, 1)]


@pytest.mark.parametrize("remove", [repeats.remove, factors.remove])
def test_partitions_of_short_texts(spark, remove):
    """A partition whose texts are all too short to repeat."""
    df = spark.createDataFrame([(i, None if i % 2 else "short") for i in range(8)], "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.n_removed) for r in remove(df).collect()) == [(i, 0) for i in range(8)]
