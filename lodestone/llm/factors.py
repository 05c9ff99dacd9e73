"""Removal of word passages that an earlier document holds, by relative Lempel-Ziv parsing.

1. Equal word sequences are one class, held by its least doc_id; each later copy of 50 words or more is removed as a whole.
2. Every window of LENGTH words has an anchor, the least hash of the runs of GRAM words in it, so equal windows have equal
   anchors; runs that very many documents hold (found in a sixteenth of the texts) are anchors only where a window holds
   nothing else. Windows in a row with one anchor are an entry; entries travel packed, by anchor, and only those whose
   anchor occurs in two different texts come back.
3. The passages of those entries, each distinct one once, go to their anchor's reference, in order of their least doc_id.
   A reference is what the passages before said anew, in blocks indexed by the hash of each window; a block beyond the
   memory is sealed, its index sorted in a file, and another one begun. A passage is parsed greedily against every block: at
   each place the indexed window there, verified word by word, is followed as far as the reference goes on alike. Such
   factors have LENGTH words or more; at a factor's end the parse goes back to the first window that crosses it, so windows
   over a boundary are looked up as well. What no block holds joins the last block.
4. Factors name their least holder; a document's words in factors whose holder is smaller go.

Passages that very many texts share are one row a text in two joins, which adaptive execution splits, and one passage in a
reference.

Defined cases: null and empty texts have nothing to remove; texts below LENGTH words stay; of rows with one doc_id neither
is smaller, so they keep what they share, fully repeated rows too; a null doc_id counts as one that is larger than all
others.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, doc_blocks, likely, mix64, raw_text, released, stream64
from .repeats import NO_ID, TAG, named, planes, shared_entries, sliding_least

LENGTH, GRAM, SHARD_BYTES, MOST_PARTS, BLOCK_WORDS = 50, 16, 4 << 20, 20_000, 1 << 19
BASE = 0x9E3779B97F4A7C15
HEAT_BITS, HEAT_SHARE, LEAST_HOT, MOST_HOT = 22, 16, 64, 1 << 16  # of the map of frequent runs; texts sampled for it; texts that make a run frequent; runs in the map


def plain(text: bytes) -> bytes:
    """The words of a text, joined by one space each; bytes.split() cuts at 09-0D and 20."""
    return b" ".join(text.split())


class Block:
    """Joined texts as words: each one's hash and the text it is in; where text i's words begin in the bytes."""

    def __init__(self, parts: list[bytes]):
        full = [p for p in parts if p]
        self.data = np.frombuffer(b" ".join(full), np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        self.start = np.concatenate(([0], gaps + 1)) if full else np.zeros(0, np.int64)
        self.end = np.append(gaps, len(self.data)) if full else np.zeros(0, np.int64)
        size = np.array([len(p) for p in parts], np.int64)
        began = np.cumsum(size + (size > 0)) - size - (size > 0)
        self.first = np.searchsorted(self.start, began)  # each text's first word
        self.first = np.append(self.first, len(self.start))
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        if not full:
            self.hash = np.zeros(0, U64)
            return
        longest = int((self.end - self.start).max())
        at = np.arange(len(self.data)) - np.repeat(self.start, np.append(np.diff(self.start), len(self.data) - self.start[-1]))
        table = stream64(256, 31)
        table[32] = 0
        part = table[self.data] * stream64(longest + 1, 32)[at]
        self.hash = mix64(np.add.reduceat(part, self.start) + (self.end - self.start).astype(U64))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` values from each place on, by doubling."""
    part, reach, out, done = values, 1, None, 0
    while True:
        factor = U64(pow(BASE, reach, 2**64))
        if width & reach:
            if out is None:
                out = part
            else:
                n = max(0, min(len(out), len(part) - done))
                out = out[:n] * factor + part[done : done + n]
            done += reach
        if done == width:
            return mix64(out)
        n = len(part) - reach
        if n <= 0:
            return np.zeros(0, U64)
        part = part[:n] * factor + part[reach:]
        reach *= 2


def entries(block: Block, length: int, gram: int, heat: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, first window, number of windows) of each run of windows with one anchor, at most 255 windows a run."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(block.doc[: len(block.doc) - length + 1] == block.doc[length - 1 :]) if len(block.doc) >= length else none
    if not len(at):
        return np.zeros(0, U64), none, none, none
    grams = rolled(block.hash, gram)
    if heat is not None:  # frequent ones rank behind all others
        grams = (grams >> U64(1)) | (heat[grams >> U64(64 - HEAT_BITS)].astype(U64) << U64(63))
    anchors, owner = sliding_least(grams, length - gram + 1)[at], block.doc[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    run = np.diff(np.append(starts, len(at)))
    pieces = -(-run // 255)
    if (pieces > 1).any():
        starts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return mix64(anchors[starts]), owner[starts], at[starts] - block.first[owner[starts]], np.diff(np.append(starts, len(at)))


def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, joined words of each) of a text column's blocks."""
    data, offsets = raw_text(column)
    for low, high in doc_blocks(offsets):
        yield low, high, [plain(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(low, high)]


def sized_words(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, sha) of each row."""

    def run(batches):
        for batch in batches:
            for low, high, parts in blocks_of(batch.column(2)):
                count = [p.count(b" ") + 1 if p else 0 for p in parts]
                digest = [hashlib.sha256(p).digest() for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(count, pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "tag", "n_words", "sha"])

    return docs.select("doc_id", F.col("tag").bitwiseAND(TAG).alias("tag"), "text").mapInArrow(released(run), "doc_id long, tag long, n_words long, sha binary")


def frequent(docs: DataFrame, gram: int, length: int) -> np.ndarray | None:
    """A map of the runs of words that many of a sixteenth of the texts hold, by the first bits of their hash; of runs with small hashes, as others are seldom anchors."""

    def run(batches):
        for batch in batches:
            for _, _, parts in blocks_of(batch.column(0)):
                block = Block(parts)
                grams = rolled(block.hash, gram)
                low = np.flatnonzero(grams < U64(1 << 62))
                held = np.unique(np.rec.fromarrays((grams[low], block.doc[low])))["f0"]  # once a text
                one, n = np.unique(held, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], ["g", "n"])

    some = docs.where(F.pmod(F.col("tag"), F.lit(HEAT_SHARE)) == 0).select("text")
    counted = some.mapInArrow(released(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_HOT)
    hot = [r.g for r in counted.orderBy(F.desc("n"), "g").limit(MOST_HOT).collect()]
    if not hot:
        return None
    heat = np.zeros(1 << HEAT_BITS, bool)
    heat[np.array(hot, np.int64).view(U64) >> U64(64 - HEAT_BITS)] = True
    return heat


def packed_entries(docs: DataFrame, parts: int, fine: int, length: int, gram: int, heat: np.ndarray | None) -> DataFrame:
    """(part, shard, docs, texts, anchor, who, at, n): the entries of each block of texts for each shard, as packed arrays. A task sends equal texts once."""
    heat = None if heat is None else docs.sparkSession.sparkContext.broadcast(np.packbits(heat))

    def run(batches):
        met: set[int] = set()
        hot = None if heat is None else np.unpackbits(heat.value).astype(bool)
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            for low, high, words in blocks_of(batch.column(1)):
                for i in range(low, high):
                    d = int.from_bytes(hashlib.blake2b(words[i - low], digest_size=8).digest(), "little") ^ int(tags[i])
                    if d in met:
                        words[i - low] = b""
                    met.add(d)
                if len(met) > 1 << 20:
                    met.clear()
                anchor, who, at, n = entries(Block(words), length, gram, hot)
                shard = (anchor % U64(fine)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                anchor, who, at, n, shard = (anchor[order] >> U64(24)), who[order], at[order], n[order], shard[order]
                cuts = np.flatnonzero(np.concatenate((shard[:1] >= 0, shard[1:] != shard[:-1])))
                rows = []
                for a, b in zip(cuts, np.append(cuts[1:], len(shard))[: len(cuts)], strict=True):  # none without entries
                    some, where = np.unique(who[a:b], return_inverse=True)
                    rows.append((int(shard[a]) % parts, int(shard[a]), planes(np.diff(ids[low + some], prepend=0), 8), planes(tags[low + some], 6), planes(anchor[a:b], 5), planes(np.diff(where, prepend=0), 4), planes(np.diff(at[a:b], prepend=0), 4), n[a:b].astype(np.uint8).tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["part", "shard", "docs", "texts", "anchor", "who", "at", "n"])

    return docs.select("doc_id", "text", "tag").mapInArrow(released(run), "part int, shard long, docs binary, texts binary, anchor binary, who binary, at binary, n binary")


HELD = np.dtype([("low", np.uint32), ("high", np.uint8), ("at", np.uint32), ("n", np.uint8)])  # as shared_entries sends them


def passages(held: DataFrame, length: int) -> DataFrame:
    """(shard, anchor, content, rep, tag, at, n) of each entry, from rows (rep, tag, text, shards, held); content: its words, one space between."""

    def run(batches):
        for batch in batches:
            reps, tags, shards, held = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for low, high, words in blocks_of(batch.column(2)):
                block, out = Block(words), []
                for i in range(low, high):
                    own = np.frombuffer(b"".join(held[i]), HELD)
                    shard = np.repeat(np.array(shards[i], np.int64), [len(x) // HELD.itemsize for x in held[i]])
                    _, one = np.unique(own["at"], return_index=True)  # copies of a text sent the same entries
                    own, shard = own[one], shard[one]
                    at, n, anchor = own["at"].astype(np.int64), own["n"].astype(np.int64), own["low"].astype(np.int64) | own["high"].astype(np.int64) << 32
                    first = block.first[i - low] + at
                    out.append((np.full(len(at), reps[i], np.int64), np.full(len(at), tags[i], np.int64), shard, anchor, at, n, block.start[first], block.end[first + n + length - 2]))
                rep, tag, shard, anchor, at, n, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
                for a in range(0, len(at), 1 << 14):
                    b = slice(a, a + (1 << 14))
                    width = end[b] - start[b]
                    ends = np.cumsum(width)
                    spot = np.repeat(start[b] - (ends - width), width) + np.arange(ends[-1])
                    content = pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(block.data[spot].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[b]), pa.array(anchor[b]), content, pa.array(rep[b]), pa.array(tag[b]), pa.array(at[b].astype(np.int32)), pa.array(n[b].astype(np.int32))], ["shard", "anchor", "content", "rep", "tag", "at", "n"])

    return held.mapInArrow(released(run), "shard long, anchor long, content binary, rep long, tag long, at int, n int")


class Sealed:
    """A reference block that grows no more: words, sorted window hashes and their places, in one mapped file."""

    def __init__(self, words: list[int], seeds: dict[int, int], holders: list[tuple[int, int]]):
        keys = np.fromiter(seeds.keys(), U64, len(seeds))
        order = np.argsort(keys)
        places = np.fromiter(seeds.values(), np.int64, len(seeds))
        self.starts, self.ids = np.array([s for s, _ in holders]), [h for _, h in holders]
        with tempfile.TemporaryFile(prefix="reference-") as file:
            file.write(np.array(words, U64).tobytes() + keys[order].tobytes() + places[order].tobytes())
            file.flush()
            held = np.memmap(file, U64, "r", shape=(len(words) + 2 * len(keys),))
        self.words, self.keys, self.places = held[: len(words)], held[len(words) : len(words) + len(keys)], held[len(words) + len(keys) :].view(np.int64)

    def find(self, seeds: list[int]) -> list[int]:
        """The place of each window, or -1."""
        at = np.minimum(np.searchsorted(self.keys, np.array(seeds, U64)), len(self.keys) - 1)
        return np.where(self.keys[at] == np.array(seeds, U64), self.places[at], -1).tolist()

    def holder(self, place: int) -> int:
        return self.ids[int(np.searchsorted(self.starts, place, "right")) - 1]

    def at(self, place: int, n: int) -> list[int]:
        return self.words[place : place + n].tolist()


class Reference:
    """What the passages so far said anew, in blocks of `most` words; passages come in order of their holders."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.sealed = length, most, []
        self._open()

    def _open(self) -> None:
        self.words: list[int] = []
        self.seeds: dict[int, int] = {}
        self.holders: list[tuple[int, int]] = []  # (place, holder) of each piece

    def holder(self, place: int) -> int:
        low, high = 0, len(self.holders)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.holders[mid][0] <= place else (low, mid)
        return self.holders[low][1]

    def at(self, place: int, n: int) -> list[int]:
        return self.words[place : place + n]

    def parse(self, words: list[int], seeds: list[int], holder: int) -> list[tuple[int, int, int]]:
        """[(first window, end window, least holder)]: the factors, and what no block holds, which joins the open block as the holder's."""
        if len(self.words) > self.most:
            self.sealed.append(Sealed(self.words, self.seeds, self.holders))
            self._open()
        n, length = len(seeds), self.length
        found = [block.find(seeds) for block in self.sealed]
        out, i, fresh = [], 0, 0
        while i < n:
            block, place = self, self.seeds.get(seeds[i], -1)
            for k, places in enumerate(found):
                if places[i] >= 0:  # earlier blocks have smaller holders
                    block, place = self.sealed[k], places[i]
                    break
            if place < 0 or block.at(place, length) != words[i : i + length]:
                i += 1
                continue
            end, place_ = i + length, place + length
            while end < len(words):
                ahead = block.at(place_, min(64, len(words) - end))
                own = words[end : end + len(ahead)]
                if not ahead:
                    break
                if ahead == own:
                    end, place_ = end + len(own), place_ + len(own)
                    continue
                same = next(k for k in range(len(own)) if own[k] != ahead[k])
                end += same
                break
            if fresh < i:
                self._add(words, seeds, fresh, i, holder)
                out.append((fresh, i, holder))
            fresh = end - length + 1
            out.append((i, fresh, block.holder(place)))
            i = fresh
        if fresh < n:
            self._add(words, seeds, fresh, n, holder)
            out.append((fresh, n, holder))
        return out

    def _add(self, words: list[int], seeds: list[int], a: int, b: int, holder: int) -> None:
        place = len(self.words)
        self.holders.append((place, holder))
        self.words += words[a : b + self.length - 1]
        self.words.append(-1 % 2**64)  # no factor goes on into the next piece
        for k in range(a, b):
            self.seeds.setdefault(seeds[k], place + k - a)


def factored(distinct: DataFrame, parts: int, length: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(c1, c2, first, until, holder): the factors of each distinct passage that several documents hold, in windows."""

    def run(batches):
        reference, last = None, None
        for batch in batches:
            _, offsets = raw_text(batch.column(2))
            shards, anchors, least, most, c1, c2 = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            for low, high in doc_blocks(offsets, 1 << 18):
                block = Block(batch.column(2).slice(low, high - low).to_pylist())
                seeds, words, first = rolled(block.hash, length).tolist(), block.hash.tolist(), block.first.tolist()
                rows = []
                for i in range(low, high):
                    a, b = first[i - low], first[i - low + 1]
                    if (shards[i], anchors[i]) != last:
                        reference, last = Reference(length, block_words), (shards[i], anchors[i])
                    rows += [(c1[i], c2[i], x, y, h) for x, y, h in reference.parse(words[a:b], seeds[a : b - length + 1], least[i]) if h < most[i]]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c1", "c2", "first", "until", "holder"])

    dealt = distinct.withColumn("part", (F.col("shard") % parts).cast("int")).repartitionById(parts, "part").sortWithinPartitions("shard", "anchor", "least", "c1", "c2")
    return dealt.select("shard", "anchor", "content", "least", "most", "c1", "c2").mapInArrow(released(run), "c1 long, c2 long, first int, until int, holder long")


def cut(held: DataFrame) -> DataFrame:
    """(rep, tag, n_removed, kept_sha256, spans) from rows (rep, tag, text, ranges)."""

    def run(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column(2))
            rows = []
            for i, ranges in enumerate(batch.column(3).to_pylist()):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                spans: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in ranges):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            types = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["rep", "tag", "n_removed", "kept_sha256", "spans"])

    return held.mapInArrow(released(run), "rep long, tag long, n_removed long, kept_sha256 string, spans array<array<int>>")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each text; spans: [start, end) of the removed runs, in words."""
    scratch = Scratch(docs.sparkSession, "factors")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    sized = scratch.table(sized_words(docs), "sized")
    total = (sized.agg(F.sum("n_words")).first()[0] or 0) * 6
    fine = max(16, int(total // SHARD_BYTES))
    parts = min(fine, MOST_PARTS)
    classes = scratch.table(sized.groupBy("sha").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that a hot text's join may be split
    members = scratch.table(sized.join(classes, "sha"), "members")

    heat = frequent(docs, gram, length)
    shared = scratch.table(shared_entries(packed_entries(docs, parts, fine, length, gram, heat), parts), "shared")
    own = members.select("doc_id", "tag", "rep").distinct()
    by_rep = shared.join(own, ["doc_id", "tag"]).groupBy("rep", "tag").agg(F.collect_list("shard").alias("shards"), F.collect_list("held").alias("held"))
    by_rep = scratch.table(by_rep, "by-rep")
    scratch.drop("shared")
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("tag").bitwiseAND(TAG).alias("tag"), "text")
    found = passages(likely(texts, by_rep.select("rep"), "rep").join(by_rep, ["rep", "tag"]).select("rep", "tag", "text", "shards", "held"), length)
    found = scratch.table(found, "passages", compression="zstd")  # the largest table
    scratch.drop("by-rep")

    distinct = named(found.groupBy("shard", "anchor", "content").agg(F.min("rep").alias("least"), F.max("rep").alias("most")))
    first = scratch.table(factored(distinct, parts, length, block_words), "found")
    hit = named(found).select("c1", "c2", "rep", "tag", "at").join(first, ["c1", "c2"]).where("holder < rep")
    ranges = hit.select("rep", "tag", F.struct((F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("until") + F.lit(length - 1)).alias("b")).alias("r"))
    ranges = scratch.table(ranges.groupBy("rep", "tag").agg(F.collect_set("r").alias("ranges")), "spans")
    scratch.drop("passages")
    changed = scratch.table(cut(likely(texts, ranges.select("rep"), "rep").join(ranges, ["rep", "tag"]).select("rep", "tag", "text", "ranges")), "changed")

    copy = (F.col("doc_id") != F.col("rep")) & (F.col("n_words") >= length)
    own = members.where(~copy).select("doc_id", "n_words", F.lower(F.hex("sha")).alias("sha"), "tag", F.when(F.col("doc_id") == F.col("rep"), F.col("rep")).alias("rep"))
    kept = own.join(changed.dropDuplicates(["rep", "tag"]), ["rep", "tag"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans")
    )
    gone = members.where(copy).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.array(F.lit(0), F.col("n_words").cast("int"))).alias("spans"))
    return kept.unionByName(gone).withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")))
