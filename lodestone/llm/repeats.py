"""Removal of byte passages that an earlier document holds, by suffix arrays over shards.

1. Equal texts are one class, held by its least doc_id; each later copy is removed as a whole.
2. Every window of LENGTH bytes has an anchor, the least hash of the GRAM-byte strings in it, so equal windows have equal
   anchors. Runs of windows with one anchor are entries; entries travel packed, by anchor, and only those whose anchor
   occurs in two different texts come back.
3. The passages of those entries, each distinct one once, go to the shard of their anchor. The suffixes of a shard's
   passages are sorted by external induced sorting with common prefixes (suffixes.py): windows between two common prefixes
   below LENGTH are equal, and the least doc_id among their passages is the first to hold them. An anchor whose texts all
   have one and the same passage has nothing to be sorted: no other passage can hold a window of it.
4. Occurrences whose doc_id is larger get those windows' bytes removed.

Passages that very many texts share are one row a text in two joins, which adaptive execution splits, and one passage in a
shard. Shards' sizes follow the text: about SHARD_BYTES of it each. Where one anchor has so many different passages that a
shard's go beyond HOT_BYTES (a line that very many texts hold, each with another neighbour), its windows travel alone, dealt
out by their own hash.

Defined cases: null and empty texts have nothing to remove; texts below LENGTH bytes stay; of rows with one doc_id neither
is smaller, so they keep the bytes that they share, fully repeated rows too; a null doc_id counts as one that is larger
than all others.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, doc_blocks, likely, mix64, raw_text, released, stream64
from .suffixes import Spill, sort

NO_ID = 2**63 - 1
HOT_BYTES = 32 << 20  # of one shard's passages
TAG = 2**48 - 1  # bits of a text's hash that tell rows with one doc_id apart
LENGTH, GRAM, SHARD_BYTES, MOST_PARTS, MEMORY = 50, 24, 4 << 20, 20_000, 48 << 20
STEP = 1 << 20  # entries of a shard's order taken at once
LOT = 1 << 21  # letters of small shards that are sorted together: each letter's queue costs something whatever it holds
BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position on, by doubling."""
    part, reach = stream64(256, 9)[data], 1
    out, done = None, 0
    while True:
        factor = U64(pow(BASE, reach, 2**64))
        if gram & reach:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                out = out[:n] * factor + part[done : done + n]
            done += reach
        if done == gram:
            return mix64(out)
        n = len(part) - reach
        if n <= 0:
            return np.zeros(0, U64)
        part = part[:n] * factor + part[reach:]
        reach *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def entries(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, first window, number of windows) of each run of windows with one anchor, at most 255 windows a run."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, U64), none, none, none
    anchors = sliding_least(gram_hashes(data, gram), length - gram + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(owner[: len(data) - length + 1] == owner[length - 1 :])
    if not len(at):
        return np.zeros(0, U64), none, none, none
    anchors, owner = anchors[at], owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    run = np.diff(np.append(starts, len(at)))
    pieces = -(-run // 255)
    if (pieces > 1).any():
        starts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.diff(np.append(starts, len(at)))
    return anchors[starts], owner[starts], at[starts] - offsets[owner[starts]], count


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all lowest bytes first: planes of zeros compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def packed_entries(docs: DataFrame, parts: int, fine: int, length: int, gram: int) -> DataFrame:
    """(part, shard, docs, texts, anchor, who, at, n): the entries of each block of texts for each shard, as packed arrays.

    Within a shard 40 bits name an anchor. A task sends equal texts once.
    """

    def run(batches):
        met: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = raw_text(batch.column(1))
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            for low, high in doc_blocks(offsets):
                own = offsets[low : high + 1] - offsets[low]
                block = data[offsets[low] : offsets[high]]
                tag = tags[low:high]
                anchor, who, at, n = entries(block, own, length, gram)
                first = np.zeros(high - low, bool)
                for i, (a, b) in enumerate(zip(own.tolist(), own[1:].tolist(), strict=False)):
                    d = (int(tag[i]), zlib.crc32(block[a:b]))
                    if d not in met:
                        met.add(d)
                        first[i] = True
                if len(met) > 1 << 20:
                    met.clear()
                keep = first[who]
                anchor, who, at, n = anchor[keep], who[keep], at[keep], n[keep]
                shard = (anchor % U64(fine)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                anchor, who, at, n, shard = (anchor[order] >> U64(24)), who[order], at[order], n[order], shard[order]
                cuts = np.flatnonzero(np.concatenate((shard[:1] >= 0, shard[1:] != shard[:-1])))
                rows = []
                for a, b in zip(cuts, np.append(cuts[1:], len(shard))[: len(cuts)], strict=True):  # none without entries
                    some, where = np.unique(who[a:b], return_inverse=True)
                    rows.append((int(shard[a]) % parts, int(shard[a]), planes(np.diff(ids[low + some], prepend=0), 8), planes(tag[some], 6), planes(anchor[a:b], 5), planes(np.diff(where, prepend=0), 4), planes(np.diff(at[a:b], prepend=0), 4), n[a:b].astype(np.uint8).tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["part", "shard", "docs", "texts", "anchor", "who", "at", "n"])

    return docs.mapInArrow(released(run), "part int, shard long, docs binary, texts binary, anchor binary, who binary, at binary, n binary")


ENTRY = np.dtype([("anchor", U64), ("shard", np.int64), ("text", np.int64), ("doc", np.int64), ("at", np.uint32), ("n", np.uint8)])
HELD = np.dtype([("low", np.uint32), ("high", np.uint8), ("at", np.uint32), ("n", np.uint8)])  # low and high: of the anchor


def shared_entries(packed: DataFrame, parts: int) -> DataFrame:
    """(shard, doc_id, tag, held): the entries whose anchor occurs in different texts, one row a shard and document; held: records of HELD."""

    def met(some: np.ndarray):
        order = np.lexsort((some["text"], some["anchor"], some["shard"]))
        some = some[order]
        if not len(some):
            return None
        starts = np.flatnonzero(np.concatenate(([True], (some["anchor"][1:] != some["anchor"][:-1]) | (some["shard"][1:] != some["shard"][:-1]))))
        ends = np.append(starts[1:], len(some))
        several = some["text"][starts] != some["text"][ends - 1]
        some = some[np.repeat(several, ends - starts)]
        if not len(some):
            return None
        some = some[np.lexsort((some["at"], some["text"], some["doc"], some["shard"]))]
        shard = np.ascontiguousarray(some["shard"])
        cuts = np.flatnonzero(np.concatenate(([True], (some["doc"][1:] != some["doc"][:-1]) | (some["text"][1:] != some["text"][:-1]) | (shard[1:] != shard[:-1]))))
        ends = np.append(cuts[1:], len(some))
        held = np.empty(len(some), HELD)
        held["low"], held["high"] = some["anchor"] & U64(0xFFFFFFFF), some["anchor"] >> U64(32)
        held["at"], held["n"] = some["at"], some["n"]
        offsets = pa.py_buffer((np.append(cuts, len(some)) * HELD.itemsize).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(some["doc"][cuts]), pa.array(some["text"][cuts]), pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(held)])], ["shard", "doc_id", "tag", "held"])

    def run(batches):
        held, size, files = [], 0, None
        for batch in batches:
            for _, shard, docs, texts, anchor, who, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = np.empty(len(n), ENTRY)
                where = np.cumsum(numbers(who, 4).astype(np.uint32), dtype=np.uint32)
                block["anchor"], block["shard"], block["n"] = numbers(anchor, 5), shard, np.frombuffer(n, np.uint8)
                block["at"] = np.cumsum(numbers(at, 4).astype(np.uint32), dtype=np.uint32)
                block["doc"], block["text"] = np.cumsum(numbers(docs, 8).view(np.int64))[where], numbers(texts, 6).view(np.int64)[where]
                held.append(block)
                size += block.nbytes
            if size > MEMORY:  # beyond the memory, entries wait in files by their anchor's first bits
                files = files or [tempfile.TemporaryFile(prefix="entries-") for _ in range(64)]
                block = np.concatenate(held)
                lot = (block["anchor"] >> U64(34)).astype(np.int64)
                for i in range(64):
                    files[i].write(block[lot == i].tobytes())
                held, size = [], 0
        rest = np.concatenate(held) if held else np.zeros(0, ENTRY)
        for i in range(64 if files else 1):
            some = rest
            if files:
                files[i].seek(0)
                some = np.concatenate((np.frombuffer(files[i].read(), ENTRY), rest[(rest["anchor"] >> U64(34)) == i]))
                files[i].close()
            out = met(some)
            if out is not None:
                yield out

    return packed.repartitionById(parts, "part").mapInArrow(released(run), "shard long, doc_id long, tag long, held binary")


def passages(held: DataFrame, length: int) -> DataFrame:
    """(shard, anchor, content, rep, tag, at, n) of each entry, from rows (rep, tag, text, shards, held)."""

    def run(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column(2))
            reps, tags, shards, held = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            out, size = [], 0
            for i, rep in enumerate(reps):
                own = np.frombuffer(b"".join(held[i]), HELD)
                shard = np.repeat(np.array(shards[i], np.int64), [len(x) // HELD.itemsize for x in held[i]])
                _, first = np.unique(own["at"], return_index=True)  # copies of a text sent the same entries
                own, shard = own[first], shard[first]
                at, n, anchor = own["at"].astype(np.int64), own["n"].astype(np.int64), own["low"].astype(np.int64) | own["high"].astype(np.int64) << 32
                out.append((np.full(len(at), rep, np.int64), np.full(len(at), tags[i], np.int64), shard, anchor, at, n, at + offsets[i]))
                size += len(at)
                if size > 1 << 16 or i == len(reps) - 1:
                    rep_, tag, shard, anchor, at, n, start = (np.concatenate(c) for c in zip(*out, strict=True))
                    width = n + length - 1
                    ends = np.cumsum(width)
                    spot = np.repeat(start - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)
                    content = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(data[spot].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(anchor), content, pa.array(rep_), pa.array(tag), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["shard", "anchor", "content", "rep", "tag", "at", "n"])
                    out, size = [], 0

    return held.mapInArrow(released(run), "shard long, anchor long, content binary, rep long, tag long, at int, n int")


class Passages:
    """A shard's passages as one text: their bytes plus 2, each ended by a 1, the whole by a 0. Arrays beyond `memory` are mapped files."""

    def __init__(self, memory: int):
        self.memory, self.file, self.blocks, self.held = memory, None, [], 0
        self.sizes: list[np.ndarray] = []
        self.numbers: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, column: pa.Array, *numbers: np.ndarray) -> None:
        data, offsets = raw_text(column)
        size = np.diff(offsets)
        letters = np.ones(len(data) + len(size), np.uint16)
        spot = np.ones(len(letters), bool)
        spot[np.cumsum(size + 1) - 1] = False
        letters[spot] = data.astype(np.uint16) + 2
        self.n += len(letters)
        self.sizes.append(size.astype(np.int32))
        self.numbers.append(numbers)
        self.blocks.append(letters)
        self.held += letters.nbytes
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile(prefix="passages-")
            for block in self.blocks:
                self.file.write(block.tobytes())
            self.blocks, self.held = [], 0

    def text(self) -> np.ndarray:
        end = np.zeros(1, np.uint16)
        if self.file is None:
            return np.concatenate((*self.blocks, end))
        for block in (*self.blocks, end):
            self.file.write(block.tobytes())
        self.file.flush()
        with self.file as file:
            return np.memmap(file, np.uint16, "r", shape=(self.n + 1,))


def first_holders(held: Passages, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first window, end window, least holder) of runs of windows with one least holder; the passages' first number is theirs."""
    text, size = held.text(), np.concatenate(held.sizes)
    least = np.concatenate([n[0] for n in held.numbers])
    order, lcp = sort(text, 258, length, held.memory)
    start = np.cumsum(size + 1, dtype=np.int64) - size - 1
    scratch = Spill(held.memory)
    owner = scratch.array(len(text), np.int32)
    owner[:-1] = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    owner[-1] = 0
    window = scratch.array(len(text), bool, 0)
    for a in range(0, len(text) - 1, STEP):
        some = owner[a : min(a + STEP, len(text) - 1)]
        window[a : a + len(some)] = np.arange(a + length, a + length + len(some)) <= (start + size)[some]
    first = scratch.array(len(text), np.int64)
    # In order, suffixes of whole windows with common prefixes of `length` are equal windows; a group may go on over steps.
    waiting, shared = [], 0
    for a in range(0, len(order), STEP):
        at, near = order[a : a + STEP], lcp[a : a + STEP]
        full = np.flatnonzero(window[at])
        if len(full):
            # The least common prefix since the window before: from the entry after it up to this one.
            met = np.minimum.reduceat(near, np.concatenate(([0], full[:-1] + 1)))
            met[0] = min(met[0], shared) if waiting else 0
            shared = near[full[-1] + 1 :].min() if full[-1] + 1 < len(near) else length
            at = at[full]
            cuts = np.flatnonzero(met < length)
            head = cuts[0] if len(cuts) else len(at)
            waiting.append(at[:head])
            if len(cuts):
                settle(first, waiting, least, owner)
                value = np.minimum.reduceat(least[owner[at]], cuts)
                first[at[cuts[0] :]] = np.repeat(value, np.diff(np.append(cuts, len(at))))
                waiting = [at[cuts[-1] :]]
        else:
            shared = min(shared, near.min())
    settle(first, waiting, least, owner)
    out = []
    for a in range(0, len(text), STEP):
        spots = np.flatnonzero(window[a : a + STEP]) + a
        if len(spots):
            value, whose = first[spots], owner[spots]
            cut_ = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])))
            ends = np.append(cut_[1:], len(spots)) - 1
            out.append((whose[cut_], spots[cut_] - start[whose[cut_]], spots[ends] + 1 - start[whose[cut_]], value[cut_]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def settle(first: np.ndarray, waiting: list[np.ndarray], least: np.ndarray, owner: np.ndarray) -> None:
    """Gives a group's windows their least holder."""
    if sum(map(len, waiting)):
        value = min(least[owner[at]].min() for at in waiting if len(at))
        for at in waiting:
            first[at] = value


def holders(distinct: DataFrame, parts: int, length: int, memory: int = MEMORY) -> DataFrame:
    """(c1, c2, first, until, holder): for each distinct passage of several holders, its windows' least holder."""

    def solve(held: Passages) -> pa.RecordBatch:
        whose, first, until, holder = first_holders(held, length)
        most, c1, c2 = (np.concatenate([n[i] for n in held.numbers]) for i in (1, 2, 3))
        real = holder < most[whose]
        whose, first, until, holder = whose[real], first[real], until[real], holder[real]
        return pa.RecordBatch.from_arrays([pa.array(c1[whose]), pa.array(c2[whose]), pa.array(first.astype(np.int32)), pa.array(until.astype(np.int32)), pa.array(holder)], ["c1", "c2", "first", "until", "holder"])

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        """What is known of passages that are their anchor's only one."""
        batch = batch.filter(pc.less(batch.column("least"), batch.column("most")))
        until = pc.subtract(pc.binary_length(batch.column("content")), length - 1)
        return pa.RecordBatch.from_arrays([batch.column("c1"), batch.column("c2"), pa.array(np.zeros(len(batch), np.int32)), until.cast(pa.int32()), batch.column("least")], ["c1", "c2", "first", "until", "holder"])

    def run(batches):
        held, last, single, before = Passages(memory), None, None, None  # single: a last row that may be its anchor's only one
        for batch in batches:
            if not len(batch):
                continue
            key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            same = np.append(before is not None and (key[0] == before).all(), (key[1:] == key[:-1]).all(axis=1))
            lone = ~same & np.append(~same[1:], True)
            if single is not None:
                if same[0]:
                    held.add(single.column(2), *(single.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)))
                else:
                    yield alone(single)
            single = batch.slice(len(batch) - 1) if lone[-1] else None
            before, several = key[-1], ~lone
            lone[-1] = False
            yield alone(batch.filter(pa.array(lone)))
            shard, batch = key[several, 0], batch.filter(pa.array(several))
            cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)])).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != last and held.n > LOT:  # small shards are sorted together
                    yield solve(held)
                    held = Passages(memory)
                last = shard[a]
                held.add(batch.column(2).slice(a, b - a), *(batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)))
        if single is not None:
            yield alone(single)
        if held.n:
            yield solve(held)

    dealt = distinct.withColumn("part", (F.col("shard") % parts).cast("int")).repartitionById(parts, "part").sortWithinPartitions("shard", "anchor")
    return dealt.select("shard", "anchor", "content", "least", "most", "c1", "c2").mapInArrow(released(run), "c1 long, c2 long, first int, until int, holder long")


def cut(held: DataFrame) -> DataFrame:
    """(rep, tag, n_removed, n_spans, kept_sha256, spans) from rows (rep, tag, text, ranges)."""

    def run(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column(2))
            rows = []
            for i, ranges in enumerate(batch.column(3).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in ranges):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                rows.append((sum(b - a for a, b in spans), len(spans), digest.hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["rep", "tag", "n_removed", "n_spans", "kept_sha256", "spans"])

    return held.mapInArrow(released(run), "rep long, tag long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>")


def windows(found: DataFrame, scratch: Scratch, length: int, hot_bytes: int, parts: int) -> DataFrame:
    """The passages, those of shards beyond `hot_bytes` cut to single windows that are dealt out by hash."""
    size = F.approx_count_distinct(F.xxhash64("content")) * F.avg(F.col("n") + length - 1)
    hot = scratch.table(found.groupBy("shard").agg(size.alias("size")).where(F.col("size") > hot_bytes).select("shard"), "hot")
    if not hot.limit(1).count():
        return found
    one = found.join(hot, "shard", "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    one = one.withColumn("content", F.expr(f"substring(content, i + 1, {length})"))
    one = one.select(F.pmod(F.xxhash64("content"), F.lit(parts)).alias("shard"), F.lit(-1).cast("long").alias("anchor"), "content", "rep", "tag", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"))
    return scratch.table(found.join(hot, "shard", "left_anti").select(*one.columns).unionByName(one), "dealt")


def named(passages: DataFrame) -> DataFrame:
    """With two independent hashes of the content."""
    return passages.withColumn("c1", F.xxhash64(F.lit(1), "content")).withColumn("c2", F.xxhash64(F.lit(2), "content"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES, memory: int = MEMORY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each text; spans: [start, end) of the removed runs."""
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    sized = scratch.table(docs.select("doc_id", F.col("tag").bitwiseAND(TAG).alias("tag"), F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "sized")
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    fine = max(16, int(total // SHARD_BYTES))
    parts = min(fine, MOST_PARTS)
    classes = scratch.table(sized.groupBy("sha").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that a hot text's join may be split
    members = scratch.table(sized.join(classes, "sha").select("doc_id", "tag", "rep", "n_bytes", "sha"), "members")

    shared = scratch.table(shared_entries(packed_entries(docs, parts, fine, length, gram), parts), "shared")
    own = members.select("doc_id", "tag", "rep").distinct()
    by_rep = shared.join(own, ["doc_id", "tag"]).groupBy("rep", "tag").agg(F.collect_list("shard").alias("shards"), F.collect_list("held").alias("held"))
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("tag").bitwiseAND(TAG).alias("tag"), "text")
    by_rep = scratch.table(by_rep, "by-rep")
    found = passages(likely(texts, by_rep.select("rep"), "rep").join(by_rep, ["rep", "tag"]).select("rep", "tag", "text", "shards", "held"), length)
    scratch.drop("shared")
    scratch.table(found, "passages", compression="zstd")  # the largest table
    del shared, by_rep, own, found
    scratch.drop("by-rep")

    found = windows(scratch.read("passages"), scratch, length, hot_bytes, parts)
    distinct = named(found.groupBy("shard", "anchor", "content").agg(F.min("rep").alias("least"), F.max("rep").alias("most")))
    first = scratch.table(holders(distinct, parts, length, memory), "holders")
    del distinct
    hit = named(found).select("c1", "c2", "rep", "tag", "at").join(first, ["c1", "c2"]).where("holder < rep")
    ranges = hit.select("rep", "tag", F.struct((F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("until") + F.lit(length - 1)).alias("b")).alias("r"))
    ranges = scratch.table(ranges.groupBy("rep", "tag").agg(F.collect_set("r").alias("ranges")), "ranges")
    del first, hit, found
    scratch.drop("passages")
    changed = scratch.table(cut(likely(texts, ranges.select("rep"), "rep").join(ranges, ["rep", "tag"]).select("rep", "tag", "text", "ranges")), "changed")

    copy = (F.col("doc_id") != F.col("rep")) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    own = members.where(~copy).select("doc_id", "n_bytes", F.lower(F.hex("sha")).alias("sha"), "tag", F.when(F.col("doc_id") == F.col("rep"), F.col("rep")).alias("rep"))
    kept = own.join(changed.dropDuplicates(["rep", "tag"]), ["rep", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
    )
    gone = members.where(copy).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.array(F.array(F.lit(0), F.col("n_bytes").cast("int"))).alias("spans"))
    return kept.unionByName(gone).withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")))
