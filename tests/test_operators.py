"""Scenario tests of the library's operators."""

import hashlib
import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import extensions
from lodestone.functions import chunking, config, ids, strings, vectors
from lodestone.operators import blocks, catalog, events, folds, graph, indexing, network, publish, search
from lodestone.sources import files
from lodestone.streaming import queries as streaming


def merged(spark, rows, limit=10, **flags):
    df = spark.createDataFrame([(c, float(s), src, f"local:{c0}" if src == "local" else c0) for c, s, src, c0 in rows], "cid string, score double, source string, source_id string")
    return search.aggregate(df, limit, id_col="cid", **flags).collect()


def test_aggregate_scenarios(spark):
    assert merged(spark, []) == []
    one = merged(spark, [("c1", 0.9, "local", "a")])
    assert (one[0].sources_count, one[0].score, one[0].overflow, one[0].total_unique) == (1, 1.0, 0, 1)
    norm = {r.cid: r.score for r in merged(spark, [("c1", 0.5, "local", "a"), ("c2", 1.0, "local", "a"), ("c3", 0.75, "local", "a")], penalties=False, boost=False)}
    assert norm == {"c1": 0.0, "c2": 1.0, "c3": 0.5}
    pen = {r.cid: r.score for r in merged(spark, [("c1", 0.9, "local", "a"), ("c2", 0.9, "network", "p1")], boost=False)}
    assert pen == {"c1": 1.0, "c2": 0.9}
    capped = merged(spark, [("c1", 0.9, "local", "a")] + [("c1", 0.9, "network", f"p{i}") for i in range(4)], penalties=False)
    assert capped[0].sources_count == 5 and capped[0].adjusted_score == pytest.approx(1.3) and capped[0].source == "local"
    twice = merged(spark, [("c1", 0.8, "local", "a"), ("c1", 0.9, "local", "a")])
    assert len(twice) == 1 and twice[0].sources_count == 2
    many = merged(spark, [(f"c{i}", i / 10, "local", "a") for i in range(5)], limit=3)
    assert [r.cid for r in many] == ["c4", "c3", "c2"] and many[0].overflow == 2 and many[0].total_unique == 5


def test_vectors(spark):
    row = spark.sql("select array(1d, 0d) a, array(0d, 0d) z, array(1d, 1d) b").select(vectors.cosine_distance(F.col("a"), F.col("z")).alias("z"), vectors.cosine_distance(F.col("a"), F.col("a")).alias("s"), vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert row.z == 1.0 and row.s == 0.0 and row.d == pytest.approx(1 - 2**-0.5)
    with pytest.raises(Exception, match="expected dimension 3"):
        spark.sql("select array(1d) a").select(vectors.checked(F.col("a"), 3)).collect()


def test_prefilter_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in search.knn(e, q, 10, most=7).collect()}
    near = {(r.query_id, r.vec_id) for r in search.knn_prefiltered(e, q, 10, planes=16, within=9).collect()}
    assert len(exact) == 10 * q.count() and len(exact & near) >= 0.9 * len(exact)


def test_knn_ties_and_zero_vectors(spark):
    e = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 0.0]) for i in range(8)] + [(9, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(3, [1.0, 0.0]), (100, [0.0, 0.0]), (101, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in search.knn(e, q, 3).collect()}
    assert got == {(3, 1): (0, 0.0), (3, 2): (1, 0.0), (3, 3): (2, 0.0), (100, 1): (0, 1.0), (100, 2): (1, 1.0), (100, 3): (2, 1.0)}
    with pytest.raises(ValueError, match="over 1"):
        search.similarities(e, q, most=1)


def test_traversal(spark):
    edges = spark.createDataFrame([(1, 1, 2, "r"), (2, 2, 3, "r"), (3, 1, 1, "r"), (4, 3, 1, "r"), (5, 1, 3, "x"), (6, 2, 9, "r")], "id long, source_id long, target_id long, edge_type string")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    start = spark.createDataFrame([(1,)], "start long")
    got = {r.id: (r.depth, r.path) for r in graph.traverse(edges, start, 2, "r", nodes).collect()}
    assert got == {2: (1, [1, 2]), 3: (2, [1, 2, 3])}
    assert {r.id: r.depth for r in graph.traverse(edges, start, 2).collect()} == {2: 1, 3: 1, 9: 2}
    with pytest.raises(ValueError, match="max depth"):
        graph.traverse(edges, start, 3)
    assert graph.edges_for(edges, 1, "both").where("source_id = target_id").count() == 2


def test_clocks(spark):
    df = spark.sql("select map('a', 1L) a, map('a', 2L, 'b', 1L) b, map('c', 1L) c")
    r = df.select(
        events.precedes(F.col("a"), F.col("b")).alias("ab"), events.precedes(F.col("b"), F.col("a")).alias("ba"), events.precedes(F.col("a"), F.col("a")).alias("aa"), events.concurrent(F.col("a"), F.col("c")).alias("ac"),
        events.merged(F.col("b"), F.col("c")).alias("m"), events.incremented(F.col("a"), F.lit("a")).alias("i"),
    ).first()
    assert (r.ab, r.ba, r.aa, r.ac) == (True, False, True, True) and r.m == {"a": 2, "b": 1, "c": 1}
    assert r.i.clocks == {"a": 2} and [(d.actor, d.n) for d in r.i.dots] == [("a", 2)]


def test_chain_finds_tampering(spark):
    log = spark.createDataFrame([(1, i, f"e{i}:", "!") for i in range(20)], "stream long, offset long, head string, tail string")
    built = events.chain(log, "stream").toPandas().sort_values("offset").reset_index(drop=True)
    assert built.prev_hash[0] == "0" * 64 and built.hash[3] == hashlib.sha256(f"e3:{built.hash[2]}!".encode()).hexdigest()
    built.loc[7, "hash"] = "f" * 64
    bad = [r.offset for r in events.verify_chain(spark.createDataFrame(built), "stream").where("not linked").collect()]
    assert bad == [8]


@pytest.mark.parametrize("kind", [chunking.Rabin, chunking.FastCdc])
def test_content_defined_cuts(kind):
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    sizes = chunking.Sizes(256, 1024, 4096)
    cuts = kind(sizes).cuts(data)
    widths = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert cuts[-1] == len(data) and all(256 <= w <= 4096 for w in widths[:-1])

    def parts(d):
        ends = kind(sizes).cuts(d)
        return {d[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    changed = data[:30_000] + b"x" + data[30_000:]
    # The rolling fingerprint's removal table keeps traces of older bytes, so it falls into step later than gear hashing does.
    assert len(parts(data) & parts(changed)) > (0.8 if kind is chunking.FastCdc else 0.4) * len(parts(data))
    assert kind(sizes).cuts(b"") == [] and kind(sizes).cuts(b"a") == [1]
    with pytest.raises(ValueError, match="sizes"):
        chunking.Sizes(10, 5, 20)


def test_rolling_fingerprint_window():
    """The fingerprint after a full window depends on the window's bytes alone, as removal by table promises."""
    r = chunking.Rabin(chunking.Sizes(1, 1 << 14, 1 << 20))
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(300))

    def rolled(d):
        h = 0
        for i, b in enumerate(d):
            if i >= chunking.WINDOW:
                h ^= r.leave[d[i - chunking.WINDOW]]
            h = ((h << 8) & chunking.U64) ^ r.enter[h >> 56] ^ b
        return h

    assert isinstance(rolled(data), int) and rolled(data) == rolled(data[:]) and r.mask == (1 << 14) - 1


def test_paragraphs():
    assert chunking.paragraphs("a\n\n b \n\n\n\nccc", 1, 4) == ["a\n\nb", "ccc"]
    assert chunking.paragraphs("aaaaaaaa\n\nb", 2, 4) == ["aaaaaaaa"]
    assert chunking.paragraphs("é" * 3, 6, 10) == ["ééé"] and chunking.paragraphs("é", 3, 10) == [] and chunking.paragraphs("", 0, 10) == []


def test_identifiers(spark):
    df = spark.createDataFrame([(b"hello",)], "data binary")
    r = df.select(ids.cid_text(ids.cid_bytes(F.col("data"))).alias("t"), ids.cid_hex(F.col("data")).alias("h")).first()
    assert r.t.startswith("bafkrei") and r.h == "01551220" + hashlib.sha256(b"hello").hexdigest()
    back = spark.createDataFrame([(r.t,), ("zzz",), (None,)], "t string").select(ids.cid_parse("t").alias("b")).collect()
    assert bytes(back[0].b).hex() == r.h and back[1].b is None and back[2].b is None


def test_extraction(spark):
    answers = ['[{"type":"Person","name":" A ","confidence":1.5}]', '```json\n[{"type":"date","name":"d","confidence":0.2}]\n```', 'Sure: [{"type":"robot","name":"x","confidence":1}]', "[]", "no json"]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, a string").select("i", strings.parse_entities(F.col("a")).alias("e"))
    got = {r.i: [(e.type, e.name, e.confidence) for e in r.e or []] for r in df.collect()}
    assert got == {0: [("person", "A", 1.0)], 1: [("date", "d", 0.2)], 2: [], 3: [], 4: []}


def test_announcement_order(spark):
    good = {"version": 1, "cid": "bafyx", "publisher_peer_id": "p", "sender": "p", "size": 1, "timestamp": 100, "publisher_did": "d", "title": "t"}
    cases = [({}, None), ({"version": 2, "cid": ""}, "unsupported_version"), ({"cid": ""}, "empty_cid"), ({"cid": "bafkx"}, "invalid_cid"), ({"sender": "q"}, "peer_mismatch"), ({"size": 0}, "invalid_size"), ({"size": 1 << 31}, "invalid_size"), ({"timestamp": 401 + 100}, "timestamp_drift"), ({"title": ""}, "empty_title")]
    df = spark.createDataFrame([(i, *{**good, **c}.values()) for i, (c, _) in enumerate(cases)], "i int, version int, cid string, publisher_peer_id string, sender string, size long, timestamp long, publisher_did string, title string")
    assert {r.i: r.e for r in df.select("i", network.announcement_error(F.lit(200)).alias("e")).collect()} == {i: e for i, (_, e) in enumerate(cases)}


def test_anchored_window(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 10, 20, 99, 100, 150, 250])], "key string, ts long, id long")
    assert [r.allowed for r in network.rate_limited(df, "key", "ts", "id", 2, 100).orderBy("id").collect()] == [True, True, False, False, True, True, True]


def test_admission(spark):
    rows = [(1, i, k, d) for i, (k, d) in enumerate([("established", "inbound"), ("established", "inbound"), ("closed", "inbound"), ("established", "outbound"), ("established", "outbound")])]
    df = spark.createDataFrame(rows, "node int, i long, kind string, direction string")
    assert [r.admitted for r in network.admit(df, "node", "i", 2, 1, "prefer_outbound").orderBy("i").collect()] == [True, False, None, True, True]


def test_spaces(spark):
    held = spark.createDataFrame([("k", "a")], "key string, name string")
    paths = spark.createDataFrame([("/x/a",), ("/y/b/",), ("/z/b",), ("/",)], "location string")
    got = {r.location: r.name for r in catalog.create_spaces(paths, held).collect()}
    key = lambda p: hashlib.sha256(p.encode()).hexdigest()
    assert got["/x/a"] == f"a-{key('/x/a')[:4]}" and got["/"] == key("/")[:8] and sorted([got["/y/b/"], got["/z/b"]])[0] == "b"


def test_manifest_edges(spark):
    chunks = spark.createDataFrame([("d", i, 1, f"c{i}") for i in range(8)] + [("e", i, 1, f"c{i}") for i in range(5)], "doc_id string, idx long, size long, cid string")
    got = {r.doc_id: (r.structure, r.depth, r.root_children) for r in blocks.manifest(chunks, 4, 5).collect()}
    assert got == {"d": ("tree", 1, 2), "e": ("tree", 0, 5)}
    assert [r.cid for r in blocks.expand(blocks.build_tree(chunks.where("doc_id = 'd'"), 5)).orderBy("pos").collect()] == [f"c{i}" for i in range(8)]


def test_file_scan(spark, tmp_path):
    for name in ("a.md", "sub/b.MD", "sub/c.txt", ".git/d.md", "build/e.md", "f.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), ["md"], ignored=["build/", "# x"]).collect()}
    assert found == {"a.md", "b.MD"}


def test_wire_formats(spark):
    value = {"b": [1, -2, 1.5, None, True, b"x"], "aa": "é", "c": {"n": 1 << 40}}
    assert files.cbor_decode(files.cbor_encode(value)) == value
    assert files.frames(b"\0\0\0\1a\0\0\0\2bc") == [b"a", b"bc"]
    for bad in (b"\0\0\0\0", b"\0\0\0\5ab"):
        with pytest.raises(ValueError, match="bad frame"):
            files.frames(bad)
    rows = [(b'{"a": 1}',), (files.cbor_encode({"a": 1}),), (b"\xff",), (None,)]
    assert [r.m for r in spark.createDataFrame(rows, "raw binary").select(files.decode_message("raw").alias("m")).collect()] == ['{"a":1}', '{"a":1}', None, None]


def test_thresholds(spark):
    rates = [(0.0, 5), (0.0, 100), (0.06, 100), (0.11, 100), (0.2, 100)]
    df = spark.createDataFrame(rates, "rate double, total int")
    assert [r.s for r in df.select(indexing.threshold_status(F.col("rate"), F.col("total"), 0.1, 10).alias("s")).collect()] == ["insufficient_data", "ok", "warning", "critical", "catastrophic"]


def test_subscription_is_idempotent(spark, tmp_path):
    spark.range(100).selectExpr("id event_id", "id offset", "id % 3 kind").write.parquet(str(tmp_path / "in"))
    handled = []

    def run():
        stream = spark.readStream.schema("event_id long, offset long, kind long").parquet(str(tmp_path / "in"))
        streaming.subscribe(stream, F.col("kind") == 1, lambda rows: handled.extend(r.offset for r in rows.collect()), str(tmp_path / "done"), str(tmp_path / f"check{len(handled)}")).start().awaitTermination()

    run()
    assert sorted(handled) == [i for i in range(100) if i % 3 == 1]
    before = len(handled)
    run()
    assert len(handled) == before


def test_router_and_monitor(spark, tmp_path):
    rows = [(i, "t", 1_000_000, 1 if i % 2 else 0, 1 if i % 5 else 2, "{}") for i in range(20)]
    spark.createDataFrame(rows, "id long, topic string, ts_ms long, ttl long, version int, props string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, topic string, ts_ms long, ttl long, version int, props string").parquet(str(tmp_path / "in"))
    streaming.route(stream, 2_000_000, 10, str(tmp_path / "store"), str(tmp_path / "stats"), str(tmp_path / "check")).start().awaitTermination()
    stats = spark.read.parquet(str(tmp_path / "stats")).first()
    assert (stats.received, stats.delivered, stats.dropped_expired, stats.dropped_invalid) == (20, 8, 8, 4)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 8
    rates = []
    runs = spark.readStream.schema("id long, topic string, ts_ms long, ttl long, version int, props string").parquet(str(tmp_path / "in")).select(F.when(F.col("version") == 2, "failed").otherwise("loaded").alias("status"))
    streaming.failure_monitor(runs, 0.1, 10, rates.append, str(tmp_path / "check2"), str(tmp_path / "counts")).start().awaitTermination()
    assert rates == [0.2]
    spark.createDataFrame(rows, "id long, topic string, ts_ms long, ttl long, version int, props string").withColumn("version", F.lit(2)).write.mode("append").parquet(str(tmp_path / "in"))
    streaming.failure_monitor(runs, 0.1, 10, rates.append, str(tmp_path / "check2"), str(tmp_path / "counts")).start().awaitTermination()
    assert rates == [0.2, 0.6]  # a restart goes on with the counts so far


def test_schema_errors(spark):
    payloads = ['{"message":"m","count":1}', '{"message":"m"}', '{"count":1}', "nope", json.dumps({"message": "m", "count": "x"})]
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert [r.e for r in df.select(events.schema_errors(F.col("p"), {"message": "string", "count": "long"}).alias("e")).collect()] == [None, "count", "message", "not_json", "count"]


def test_append_goes_on_from_heads(spark):
    """Two appends make the chain and clocks that one makes; another one's payloads are refused with their reasons."""
    registry = events.Schemas().register("a", 1, {"k": "long"})
    rows = [(i, i % 2, "a" if i != 5 else "b", 1, '{"k":%d}' % i if i != 7 else "{}", datetime(2024, 1, 1, 0, i), f"d{i % 3}", "" if i == 9 else "s", "t") for i in range(20)]
    kind = "event_id long, stream long, type string, schema_version int, payload string, ts timestamp, signer string, sig string, sig_type string"
    df = spark.createDataFrame(rows, kind)
    whole, refused = events.append(df, registry)
    assert {r.event_id: r.error for r in refused.collect()} == {5: "schema_not_found", 7: "k", 9: "invalid_payload"}
    first, _ = events.append(df.where("event_id < 12"), registry)
    rest, _ = events.append(df.where("event_id >= 12"), registry, events.heads(first))
    key = lambda d: sorted((r.event_id, r.offset, r.clock, r.prev_hash, r.hash) for r in d.collect())
    assert key(first.unionByName(rest)) == key(whole)


def test_offsets_of_a_hot_time(spark):
    rows = [(i, datetime(2024, 1, 1) if i % 3 else datetime(2024, 1, 1, 0, i % 60), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, s long")
    expected = {i: n for n, (_, i) in enumerate(sorted((ts, i) for i, ts, _ in rows))}
    assert {r.event_id: r.offset for r in events.append_offsets(df, parts=7).collect()} == expected
    for stream in (0, 1):
        own = {i: n for n, (_, i) in enumerate(sorted((ts, i) for i, ts, s in rows if s == stream))}
        assert {r.event_id: r.offset for r in events.append_offsets(df, stream="s", parts=7).where(F.col("s") == stream).collect()} == own


def test_read_tree_errors(spark):
    roots = spark.createDataFrame([("d", ["n1", "c3"]), ("e", ["c1", "c9"])], "doc_id string, children array<string>")
    nodes = spark.createDataFrame([(1, "n1", ["c1", "c2"])], "level int, cid string, links array<string>")
    held = spark.createDataFrame([(c,) for c in ("c1", "c2", "c3")], "cid string")
    got = sorted((r.doc_id, r.pos, r.cid, r.error) for r in publish.read_tree(roots, nodes, held).collect())
    assert got == [("d", 0, "c1", "mixed_levels"), ("d", 1, "c2", "mixed_levels"), ("d", 2, "c3", "mixed_levels"), ("e", 0, "c1", None), ("e", 1, "c9", "missing_block")]


def test_announcements_follow_the_network(spark):
    chunks = spark.createDataFrame([("d", 0, 3, "c0"), ("d", 1, 3, "c1")], "doc_id string, idx int, size long, cid string")
    meta = spark.createDataFrame([("d", "name", "text/plain", "did:me"), ("e", None, None, "did:me")], "doc_id string, name string, content_type string, publisher string")
    off, _, announced = publish.publish_dag(chunks, meta, running=False)
    assert {(r.doc_id, r.dht, r.gossip, r.chunk_count) for r in off.collect()} == {("d", "not_attempted", "not_attempted", 2), ("e", "not_attempted", "not_attempted", 0)} and announced.count() == 0
    on, stored, announced = publish.publish_dag(chunks, meta, dht=False)
    assert {(r.dht, r.gossip) for r in on.collect()} == {("skipped", "success")} and announced.count() == 0 and stored.count() == 4


@pytest.mark.parametrize("kind", [chunking.Rabin, chunking.FastCdc])
def test_chunking_a_stream(kind):
    """Chunks of buffers of any size are those of the whole, and the buffer stays below the largest chunk and one buffer."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 120_000, dtype=np.uint8).tobytes()
    cutter = kind(chunking.SMALL)
    whole = [data[a:b] for a, b in zip([0, *cutter.cuts(data)], cutter.cuts(data), strict=False)]
    for size in (1, 700, 50_000):
        parts = (data[i : i + size] for i in range(0, len(data), size)) if size > 1 else (bytes([b]) for b in data[:9000])
        got = list(chunking.streamed(parts, cutter))
        assert b"".join(got) == (data if size > 1 else data[:9000]) and (size == 1 or got == whole)
    assert isinstance(chunking.Streaming(cutter), extensions.Chunker)


@pytest.mark.parametrize("kind", [chunking.Rabin, chunking.FastCdc])
def test_cuts_byte_by_byte(kind):
    """The block form of the hashes finds the cuts of the plain one."""
    rng = np.random.default_rng(5)
    for data in (b"", b"a", bytes(5000), rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), b"abc" * 9000):
        assert kind(chunking.SMALL).cuts(data) == kind(chunking.SMALL).cuts_plain(data)


def test_settings(monkeypatch):
    monkeypatch.setenv("N", "7")
    monkeypatch.setenv("BAD", "x1")
    monkeypatch.setenv("NEG", "-3")
    assert (config.whole("N", 1), config.whole("BAD", 1), config.whole("NONE", 2), config.whole("NEG", 5, 0), config.whole("NEG", 5)) == (7, 1, 2, 5, -3)
    for text, value in (("TRUE", True), ("on", True), ("0", False), ("maybe", False)):
        monkeypatch.setenv("FLAG", text)
        assert config.flag("FLAG", True) is value
    assert config.flag("NONE", True) is True and config.text("NONE") is None and config.text("N") == "7" and str(config.path("NONE", "/d")) == "/d"
    assert config.seconds("N", 1).total_seconds() == 7 and config.milliseconds("NONE", 1500).total_seconds() == 1.5


def test_registry_and_adapters(spark):
    held = extensions.Registry()
    held.register("x", 1)
    with pytest.raises(ValueError, match="x is registered"):
        held.register("x", 2)
    with pytest.raises(KeyError, match="unknown: y"):
        held["y"]
    with pytest.raises(ValueError, match="invalid scope"):
        extensions.gathered([], None, 1, "elsewhere")


def test_embedder_is_pluggable(spark):
    docs = spark.createDataFrame([(1, "some words that are long enough to be kept as one chunk of text")], "doc_id long, text string")
    flat = lambda text, dimensions: F.array_repeat(F.length(text).cast("float"), dimensions)
    row = indexing.index(docs, 10, 1000, 3, embedder=flat).first()
    assert row.embedding == [float(len(row.chunk))] * 3


def test_upsert_replaces_held_rows(spark, tmp_path):
    kind = "collection string, cid string, chunk_index int, embedding array<float>"
    files.upsert_vectors(spark.createDataFrame([("a", "c1", 0, [1.0]), ("a", "c2", 0, [2.0]), ("b", "c1", 0, [3.0])], kind), str(tmp_path / "v"))
    files.upsert_vectors(spark.createDataFrame([("a", "c1", 0, [9.0]), ("a", "c3", 0, [4.0])], kind), str(tmp_path / "v"))
    got = {(r.collection, r.cid): r.embedding for r in files.vectors(spark, str(tmp_path / "v")).collect()}
    assert got == {("a", "c1"): [9.0], ("a", "c2"): [2.0], ("a", "c3"): [4.0], ("b", "c1"): [3.0]}


def test_cache_expires_and_evicts():
    step, state, got = folds.cached(2, 100), None, []
    for query, ts in (("a", 0), ("a", 50), ("b", 60), ("a", 99), ("c", 101), ("b", 102), ("a", 103), ("a", 203)):
        state, (hit,) = step(state, (query, ts))
        got.append(hit)
    assert got == [False, True, False, True, False, False, False, False]


def test_answer_without_context(spark):
    chunks = spark.createDataFrame([], "q long, rank long, content string")
    asked = spark.createDataFrame([(1, "why?")], "q long, question string")
    row = indexing.answers(asked, chunks).first()
    assert row.error == "NO_CONTEXT" and row.prompt is None
