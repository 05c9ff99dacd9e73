"""Streams that end by a timer: sessions that expire without an event, and gathered answers that stop at a number of peers or at their time.

State is kept by key and event time: a watermark behind the newest event tells when a time has passed, so a stream that is
run again ends the same. Rows of a key that come in one batch are taken in order of time, then of their id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION_MS = 300_000
BUCKETS = 4096  # groups that gathered keys are dealt into
CHUNK = 10_000  # rows of a group that are tuples at once


def taken(parts: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """A group's rows in order of time and id, nulls last, as tuples (ts_ms, id, *columns): most groups have a few, for which frames cost more than the work."""
    held = [[part[c].to_numpy() for c in ("ts_ms", "id", *columns)] for part in parts]
    values = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.lexsort((values[1], values[0]))
    for at in range(0, len(order), CHUNK):
        yield from zip(*(v[order[at : at + CHUNK]].tolist() for v in values), strict=True)


def challenges(stream: DataFrame, ttl_ms: int = SESSION_MS, late: str = "0 seconds", most: int = 1 << 16) -> DataFrame:
    """(key, id, ts_ms, outcome) of events (key, id, ts, kind): an issued challenge answers one finish within its time; a new one replaces it.

    outcome: issued; accepted; missing, for a finish without an open challenge; and expired, sent by the timer at the time
    that a challenge ran out, with the id that issued it. late: how long events of another key may come after newer ones.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        issued, number = state.get if state.exists else (None, None)
        out = []

        def expire(now: int) -> None:
            nonlocal issued
            if issued is not None and now - issued > ttl_ms:
                out.append((key[0], int(number), int(issued) + ttl_ms, "expired"))
                issued = None

        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs() + 1)
        else:
            for ts, one, kind in taken(parts, "kind"):
                expire(ts)
                if kind == "issue":
                    issued, number = ts, one
                    out.append((key[0], one, ts, "issued"))
                else:
                    out.append((key[0], one, ts, "missing" if issued is None else "accepted"))
                    issued = None
        if issued is None:
            state.remove()
        else:
            state.update((int(issued), int(number)))
            state.setTimeoutTimestamp(max(int(issued) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "ts_ms", "outcome"])

    kinds = dict(stream.dtypes)
    rows = stream.withWatermark("ts", late).select("key", "id", "ts", "kind", F.unix_millis("ts").alias("ts_ms"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, id long, ts_ms long, outcome string", "issued long, number long", "append", GroupStateTimeout.EventTimeTimeout)


def gathered(stream: DataFrame, peers: int, timeout_ms: int, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(key, peers, results, first_ms, done_ms, reason) of each query (key): what its peers answered until enough had, or its time was over.

    Rows (key, id, ts, kind, peer, results): kind "query" opens a key, "answer" counts unless it comes before the query,
    after its end, or from a peer that has answered. reason: "enough" or "timeout"; a query without answers ends too.
    Calls of Python go by buckets of keys, since most keys have few rows and a call costs as much as hundreds of them; a
    bucket's state is a list of its keys with a query whose time isn't over.
    """

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {key: [opened, list(told), results, closed] for key, opened, told, results, closed in zip(*state.get, strict=True)} if state.exists else {}
        out = []

        def end(key, at: int, reason: str) -> None:
            one = held[key]
            one[3] = True
            out.append((key, sum(p is not None for p in one[1]), one[2], one[0], at, reason))  # an unnamed peer takes a place, but doesn't count

        if not state.hasTimedOut:
            for ts, _, key, kind, peer, n in taken(parts, "key", "kind", "peer", "results"):
                one = held.get(key)
                if kind == "query":
                    if one is None:
                        held[key] = [int(ts), [], 0, False]
                    continue
                if one is None or one[3]:
                    continue
                if ts - one[0] > timeout_ms:
                    end(key, one[0] + timeout_ms, "timeout")
                elif peer not in one[1]:
                    one[1].append(peer)
                    one[2] += int(n)
                    if len(one[1]) >= peers:
                        end(key, int(ts), "enough")
        now = state.getCurrentWatermarkMs()
        for key in [key for key, one in held.items() if one[0] + timeout_ms + 1 < now]:  # a closed query is remembered until its time is over, so that late answers don't open another
            if not held[key][3]:
                end(key, held[key][0] + timeout_ms, "timeout")
            del held[key]
        if held:
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(one[0] for one in held.values()) + timeout_ms + 1, now + 1))
        elif state.exists:
            state.remove()
        if out:  # a bucket that nothing was asked of has no rows
            yield pd.DataFrame(out, columns=["key", "peers", "results", "first_ms", "done_ms", "reason"])

    kinds = dict(stream.dtypes)
    bucket, n = F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("results").cast("long"), F.lit(0)).alias("results")
    counted = stream.withWatermark("ts", late).where("ts is not null and (kind = 'query' or kind = 'answer' and key is not null)")  # an answer to null answers none, as in a join
    rows = counted.select(bucket, "key", "id", "ts", "kind", F.col("peer").cast("string").alias("peer"), n, F.unix_millis("ts").alias("ts_ms"))
    shape = f"keys array<{kinds['key']}>, opened array<long>, held array<array<string>>, results array<long>, closed array<boolean>"
    return rows.groupBy("bucket").applyInPandasWithState(run, f"key {kinds['key']}, peers long, results long, first_ms long, done_ms long, reason string", shape, "append", GroupStateTimeout.EventTimeTimeout)


def buffered(stream: DataFrame, size: int = 1000) -> DataFrame:
    """(key, id, outcome, lag, got) of rows (key, id, ts, kind): a subscriber's ring buffer of `size` messages. "message" puts one in; "read" takes the oldest that is left.

    outcome of a message: kept. Of a read: the id it got is `got`; "lagged" with the number of messages lost since its last
    read, which the read skips as a receiver that fell behind does; "read"; or "empty". State: numbers and the ring's ids.
    A subscriber may have many rows in a batch: they are held as arrays, and given out in chunks.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, read, held = state.get if state.exists else (0, 0, [])
        ring, rows = deque(held, size), taken(parts, "kind")
        while some := list(islice(rows, CHUNK)):
            out = []
            for _, one, kind in some:
                one = None if one != one else int(one)  # a null among numbers comes as a float
                if kind == "message":
                    ring.append(one)  # the oldest goes when it is full
                    sent += 1
                    out.append((key[0], one, "kept", 0, None))
                    continue
                lost = sent - len(ring) - read
                if not ring:
                    out.append((key[0], one, "empty", 0, None))
                    continue
                read = sent - len(ring) + 1
                out.append((key[0], one, "lagged" if lost else "read", lost, ring.popleft()))
            yield pd.DataFrame(out, columns=["key", "id", "outcome", "lag", "got"]).astype({"id": "Int64", "got": "Int64"})
        state.update((sent, read, list(ring)))

    kinds = dict(stream.dtypes)
    rows = stream.select("key", "id", "kind", F.unix_millis("ts").alias("ts_ms"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, id long, outcome string, lag long, got long", "sent long, taken long, ring array<long>", "append", GroupStateTimeout.NoTimeout)
