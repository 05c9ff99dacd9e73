"""The event log as a source, dispatched handlers over restarts, and streams that end by timers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files
from lodestone.streaming import dispatch, timers
from lodestone.streaming.queries import run_to_files


def made(spark, low, high):
    rows = [(i, 1_700_000_000 + i, ["click", "view"][i % 2]) for i in range(low, high)]
    return spark.createDataFrame(rows, "event_id long, s long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type")


def test_segments():
    assert dispatch.segments(["segment=5-9", "_writer", "segment=0-5"]) == [(0, 5, "segment=0-5"), (5, 9, "segment=5-9")]
    with pytest.raises(ValueError, match="offset 5 is missing"):
        dispatch.segments(["segment=0-5", "segment=6-9"])


def test_log_reads_ranges(spark, tmp_path):
    log = str(tmp_path / "log")
    assert dispatch.append(made(spark, 0, 70), log) == (0, 70) and dispatch.append(made(spark, 70, 100), log) == (70, 100) and dispatch.append(made(spark, 0, 0), log) == (100, 100)
    reader = dispatch.EventLogReader({"path": log, "most": "60", "rows": "25", "from": "10"}, spark.read.parquet(log).select("event_id", "ts", "offset").schema)
    assert reader.initialOffset() == {"offset": 10} and reader.latestOffset() == {"offset": 70} and reader.latestOffset() == {"offset": 100} and reader.latestOffset() == {"offset": 100}
    parts = reader.partitions({"offset": 10}, {"offset": 100})
    assert [p.value[1:] for p in parts] == [(10, 35), (35, 60), (60, 70), (70, 95), (95, 100)]
    got = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert sorted((x["offset"], x["event_id"], int(x["ts"].timestamp())) for x in got) == [(i, i, 1_700_000_000 + i) for i in range(10, 100)]
    with files.locked(spark, f"{log}/_writer"):
        with pytest.raises(RuntimeError, match="another writer"):
            dispatch.append(made(spark, 100, 101), log)


def test_dispatcher_goes_on_after_a_failure(spark, tmp_path):
    """Two handlers with bookmarks of their own; one fails in its third batch and is resumed by another dispatcher; new segments follow; a doubled event is handled once."""
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    dispatch.append(made(spark, 0, 100), log)
    seen = {"clicks": [], "all": []}
    trouble = [True]

    def clicks(rows):
        got = sorted(r.offset for r in rows.select("offset").collect())
        if trouble[0] and got and got[-1] >= 90:
            raise ValueError("no")
        seen["clicks"].append(got)

    def every(rows):
        seen["all"].append(sorted(r.offset for r in rows.select("offset").collect()))

    def dispatcher():
        return dispatch.Dispatcher(spark, log, state, batch=40).register("clicks", clicks, F.col("event_type") == "click").register("all", every)

    first = dispatcher()
    with pytest.raises(RuntimeError, match="clicks failed at offset 80"):
        first.poll()
    assert first.bookmark("all") == 100 and first.bookmark("clicks") == 80
    assert seen["all"] == [list(range(40)), list(range(40, 80)), list(range(80, 100))] and seen["clicks"] == [list(range(0, 40, 2)), list(range(40, 80, 2))]
    dispatch.append(made(spark, 100, 110), log)
    trouble[0] = False
    again = dispatcher()
    assert again.poll() == {"clicks": 110, "all": 110}
    # The keys of the failed batch were claimed before the handler ran, so it isn't run again with them.
    assert sum(seen["all"], []) == list(range(110)) and seen["clicks"][-1] == list(range(100, 110, 2))
    assert again.poll() == {"clicks": 110, "all": 110} and sum(seen["all"], []) == list(range(110))
    with pytest.raises(ValueError):
        again.register("all", every)


def test_a_batch_is_dealt_out_by_its_own_size(spark, tmp_path, monkeypatch):
    """Not into the session's four partitions, whose tasks and files would cost more than the work; and ranges are read from row groups of their size."""
    from pyarrow import parquet

    monkeypatch.setattr(dispatch, "BLOCK", 4096)
    monkeypatch.setattr(dispatch, "RANGE", 1000)
    log, seen, parts = str(tmp_path / "log"), [], []

    def handle(rows):
        parts.append(rows.rdd.getNumPartitions())
        seen.extend(r.offset for r in rows.select("offset").collect())

    dispatch.append(made(spark, 0, 5000), log)
    state = str(tmp_path / "state")
    assert dispatch.Dispatcher(spark, log, state, batch=2000, keep=100).register("all", handle).poll() == {"all": 5000}
    assert sorted(seen) == list(range(5000)) and parts == [2, 2, 2]
    (held,) = (tmp_path / "state/all/handled").iterdir()
    assert len(list(held.glob("*.parquet"))) <= 3 and spark.read.parquet(str(held)).count() == 1100
    files_ = list((tmp_path / "log").glob("segment=*/*.parquet"))
    assert max(parquet.ParquetFile(f).metadata.row_group(0).num_rows for f in files_) < 1000


def test_handlers_share_no_registered_source(spark, tmp_path):
    d = dispatch.Dispatcher(spark, str(tmp_path / "log"), str(tmp_path / "state")).register("a", print).register("b", print)
    assert d.handlers["a"][2] != d.handlers["b"][2]


def stream_of(spark, tmp_path, rows, schema, batches=1):
    """A stream whose batches are given lists of rows."""
    path = str(tmp_path / "in")
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        part.coalesce(1).write.mode("append").parquet(f"{path}")
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches", [1, 4])
def test_challenges(spark, tmp_path, batches):
    rng, rows = random.Random(1), []
    for i in range(200):
        rows.append((f"k{rng.randrange(8)}", i, (i + 1) * 20_000, rng.choice(["issue", "finish", "finish"])))
    rows.append(("last", 200, 20_000_000, "issue"))
    want, held = [], {}
    for key, i, ms, kind in rows:
        if key in held and ms - held[key][0] > 300_000:
            want.append((key, held[key][1], held.pop(key)[0] + 300_000, "expired"))
        if kind == "issue":
            held[key] = (ms, i)
            want.append((key, i, ms, "issued"))
        else:
            want.append((key, i, ms, "accepted" if held.pop(key, None) else "missing"))
    want += [(k, i, ms + 300_000, "expired") for k, (ms, i) in held.items() if k != "last"]
    out = run_to_files(timers.challenges(stream_of(spark, tmp_path, rows, "key string, id long, ms long, kind string", batches)))
    assert sorted(tuple(r) for r in out.select("key", "id", "ts_ms", "outcome").collect()) == sorted(want)


def test_gather_stops(spark, tmp_path):
    """Enough peers end a query at once; others end by the timer, without an event; late and repeated answers don't count."""
    at = [("q1", "query", "me", 1), ("q1", "answer", "a", 100), ("q1", "answer", "a", 150), ("q1", "answer", "b", 200), ("q1", "answer", "c", 250), ("q2", "query", "me", 300), ("q2", "answer", "a", 400), ("q2", "answer", "b", 2000), ("q3", "query", "me", 500), ("q4", "answer", "a", 600), ("end", "query", "me", 60_000)]
    rows = [(k, i, ms, kind, peer, 2) for i, (k, kind, peer, ms) in enumerate(at)]
    out = run_to_files(timers.gathered(stream_of(spark, tmp_path, rows, "key string, id long, ms long, kind string, peer string, results long"), 2, 500))
    assert sorted(tuple(r) for r in out.collect()) == [("q1", 2, 4, 1, 200, "enough"), ("q2", 1, 2, 300, 800, "timeout"), ("q3", 0, 0, 500, 1000, "timeout")]


@pytest.mark.parametrize("batches", [1, 3])
def test_buffers(spark, tmp_path, batches):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, i + 1, "message" if rng.random() < 0.7 else "read") for i in range(300)]
    want, state = [], {}
    for key, i, _, kind in rows:
        ring, lost = state.setdefault(key, [[], 0])
        if kind == "message":
            ring.append(i)
            if len(ring) > 5:
                ring.pop(0)
                state[key][1] += 1
            want.append((key, i, "kept", 0, None))
        elif ring:
            want.append((key, i, "lagged" if lost else "read", lost, ring.pop(0)))
            state[key][1] = 0
        else:
            want.append((key, i, "empty", 0, None))
    out = run_to_files(timers.buffered(stream_of(spark, tmp_path, rows, "key string, id long, ms long, kind string", batches), 5))
    assert sorted((tuple(r) for r in out.select("key", "id", "outcome", "lag", "got").collect()), key=lambda r: r[1]) == want


def test_buffers_of_long_keys_and_nulls(spark, tmp_path, monkeypatch):
    """A key's rows come in several frames and go out in several; ids may be null, also within the ring."""
    monkeypatch.setattr(timers, "CHUNK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("a", i if i % 7 else None, 40 - i, "read" if i % 3 == 0 else "message") for i in range(1, 25)]
        out = run_to_files(timers.buffered(stream_of(spark, tmp_path, rows, "key string, id long, ms long, kind string"), 2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ring, lost, want = [], 0, []
    for _, i, _, kind in reversed(rows):
        if kind == "message":
            lost += len(ring) == 2
            ring = [*ring, i][-2:]
            want.append((i, "kept", 0, None))
        elif ring:
            want.append((i, "lagged" if lost else "read", lost, ring.pop(0)))
            lost = 0
        else:
            want.append((i, "empty", 0, None))
    assert sorted(((r.id, r.outcome, r.lag, r.got) for r in out), key=str) == sorted(want, key=str)
