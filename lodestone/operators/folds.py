"""Folds over the rows of each key in order, with a bounded state: what a window can't express, since each step needs the last one's outcome.

A fold is a step (state, row) -> (state, outputs) on plain tuples. The batch form sorts rows by key within partitions and
keeps one key's state at a time, so a key of any length takes a few variables; the stream form keeps the state of each key
between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], step: Step, out: str) -> DataFrame:
    """(key, *order, *out) of each row; out: names and types of what a step returns. A key's first state is None."""
    names = list(dict.fromkeys([key, *order, *columns]))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys([key, *order]))
    spots = [names.index(c) for c in columns]
    result = rows.sparkSession.createDataFrame([], f"{schema}, {out}").schema
    leading = len(dict.fromkeys([key, *order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        held, state, started = None, None, False
        for batch in batches:
            made = []
            values = [c.to_pylist() for c in batch.columns]
            for row in zip(*values, strict=True):
                if not started or row[0] != held:
                    held, state, started = row[0], None, True
                state, found = step(state, tuple(row[i] for i in spots))
                made.append(found)
            kept = batch.columns[:leading]
            outs = [pa.array(c, arrow.field(len(kept) + i).type) for i, c in enumerate(zip(*made, strict=True))]
            if made:
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(kept)] + outs, schema=arrow)

    return rows.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, result)


def streamed(stream: DataFrame, key: str, order: list[str], columns: list[str], step: Step, out: str, state: str, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream; state: names and types of a state's fields. A key idle for `idle_ms` loses its state."""
    names = list(dict.fromkeys([key, *order, *columns]))
    kinds = dict(stream.dtypes)
    kept = list(dict.fromkeys([key, *order]))
    fields = [part.split()[0] for part in out.split(",")]

    def run(_: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = tuple(held.get) if held.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        made = []
        for row in zip(*(rows[c].tolist() for c in columns), strict=True):
            now, found = step(now, row)
            made.append(found)
        held.update(now)
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield pd.concat([rows[kept].reset_index(drop=True), pd.DataFrame(made, columns=fields)], axis=1)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {out}"
    return stream.select(*names).groupBy(key).applyInPandasWithState(run, schema, state, "append", timeout)


def anchored(most: int, window_ms: int) -> Step:
    """(ts) -> (allowed): at most `most` rows in a window anchored at its first row; a row `window_ms` or more after it opens the next."""

    def step(state, row):
        anchor, used = state or (None, 0)
        if anchor is None or row[0] - anchor >= window_ms:
            anchor, used = row[0], 0
        allowed = used < most
        return (anchor, used + allowed), (allowed,)

    return step


def admitted(most: int, reserved: int = 0, policy: str = "strict") -> Step:
    """(kind, direction) -> (admitted): a connection is refused at the limit (0: none); a close frees a place; null for other kinds."""

    def step(state, row):
        (active,), (kind, direction) = state or (0,), row
        if kind == "established":
            limit = max(0, most - reserved) if direction == "inbound" and policy == "prefer_outbound" else most
            ok = most == 0 or active < limit
            return (active + ok,), (ok,)
        return (max(0, active - (kind == "closed")),), (None,)

    return step


def lifecycle(state, row):
    """(kind) -> (connections, reconnections, failures): a peer's open connections; further ones, or ones after all were closed, are reconnections; success clears failures."""
    (connections, known, reconnections, failures), (kind,) = state or (0, False, 0, 0), row
    if kind == "established":
        reconnections += connections > 0 or known
        connections, known, failures = connections + 1, True, 0
    elif kind == "closed":
        connections = max(0, connections - 1)
    elif kind == "failed":
        failures += 1
    return (connections, known, reconnections, failures), (connections, reconnections, failures)


def challenged(ttl_ms: int) -> Step:
    """(kind, ts) -> (outcome): an issued challenge answers one finish within its time; a new one replaces it."""

    def step(state, row):
        (issued,), (kind, ts) = state or (None,), row
        if kind == "issue":
            return (ts,), ("issued",)
        return (None,), ("missing" if issued is None else "expired" if ts - issued > ttl_ms else "accepted",)

    return step


def cached(capacity: int, ttl_ms: int) -> Step:
    """(query, ts) -> (hit): a least-recently-used cache of answers; a miss stores one, and an answer is good for `ttl_ms` from then."""

    def step(state, row):
        (held,), (query, ts) = state or ({},), row
        stored = held.pop(query, None)
        hit = stored is not None and ts - stored < ttl_ms
        held[query] = stored if hit else ts
        if len(held) > capacity:
            del held[next(iter(held))]
        return (held,), (hit,)

    return step
