"""The trie of conversations' turns, by an external mergesort that carries longest common prefixes.

1. A conversation is a path: 16 bytes of each turn's digest, so paths compare as bytes and any node's members are
   neighbours in order.
2. Paths are dealt out by ranges of (path, conv_id). A task sorts what fits in its memory into runs, each entry with the
   prefix it shares with the one before (in turns), and merges the runs with a tree of losers: two heads whose shared
   prefixes with the last winner differ are ordered by those alone, and others are compared from the shared turns on.
3. The merged stream keeps a stack, the open path. An entry closes what lies below its shared prefix; a closed node is
   finished. Finished nodes wait in a file, which is read backwards, so that a parent's least member is known before
   its children's rows are made.
4. Nodes on a range's first or last path may go on in its neighbours. They leave as partial sums, a range's first and last
   path each, and one more stack over the ranges' borders sums them: its rows follow the ranges, not the conversations.

Equal conversations, however many, lie in as many ranges as they fill. Their members' ids are hashed one after another, as
SHA-256 asks, from one packed row a range.

Defined cases: rows without a conv_id belong to no conversation and are left out; null role or text is empty; turns with
one number are ordered by role, then text (its first 64 characters, then its digest); a repeated row is a turn of its own;
conversations without turns are members of the root alone; an empty table has no nodes. A conversation's digests (16 bytes
a turn) and sizes are one value.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released

DIGEST, MEMORY, RANGE_TURNS = 16, 32 << 20, 1 << 19
EMPTY = hashlib.sha256(b"").hexdigest()
Entry = tuple[bytes, int, list[int]]  # path, conversation, each turn's bytes


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    row = F.struct(F.col("turn"), role.alias("role"), F.substring(text, 1, 64).alias("lead"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    held = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def regrafted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first h turns of each conversation taken from conversation c - c % 5; h = crc32(c) % 9."""
    own = turns(conversations)
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    met = own.withColumn("base", F.expr("conv_id - conv_id % 5")).withColumn("h", F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 9 as int)")).join(heads, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    return met.select("conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def common(a: bytes, b: bytes, known: int) -> int:
    """Turns that two paths share, of which `known` are known."""
    at, end = known * DIGEST, min(len(a), len(b))
    while at < end and a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


class Runs:
    """Sorted runs of (shared turns, path, conversation, sizes); beyond the memory they lie in a temporary file."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.bytes, self.file, self.ends = memory, [], 0, None, [0]

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        self.held.append((path, conv, sizes))
        self.bytes += 120 + len(path) + 8 * len(sizes)
        if self.bytes > self.memory:
            self.spill()

    def ordered(self) -> Iterator[tuple[int, Entry]]:
        self.held.sort(key=lambda e: e[:2])
        before = b""
        for entry in self.held:
            yield common(before, entry[0], 0), entry
            before = entry[0]

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="runs-")
        self.file.seek(0, 2)
        for shared, (path, conv, sizes) in self.ordered():
            self.file.write(np.array([shared, conv, len(sizes), *sizes], np.int64).tobytes() + path)
        self.ends.append(self.file.tell())
        self.held, self.bytes = [], 0

    def read(self, at: int, end: int, block: int) -> Iterator[tuple[int, Entry]]:
        """A run of the file, `block` bytes at once; all runs take turns with one file."""
        data = b""
        while at < end or data:
            low = 0
            while len(data) - low >= 24:
                shared, conv, n = np.frombuffer(data, np.int64, 3, low).tolist()
                width = 24 + (8 + DIGEST) * n
                if len(data) - low < width:
                    break
                yield shared, (data[low + 24 + 8 * n : low + width], conv, np.frombuffer(data, np.int64, n, low + 24).tolist())
                low += width
            data = data[low:]
            if at < end:
                self.file.seek(at)
                data += self.file.read(min(block, end - at))
                at = min(at + block, end)

    def merged(self) -> Iterator[tuple[int, Entry]]:
        runs = len(self.ends) - 1
        block = max(1 << 16, self.memory // (4 * max(1, runs)))
        yield from merge([*(self.read(a, b, block) for a, b in zip(self.ends, self.ends[1:], strict=False)), self.ordered()])


def merge(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """(turns shared with the entry before, entry) of all runs in order, by a tree of losers that carries shared prefixes."""
    k = len(runs)
    heads: list[tuple[int, Entry] | None] = [next(r, None) for r in runs]
    shared = [0] * k  # of each head with the entry that beat it last, which at a replay is the one last sent
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:  # the one that shares more with the last winner is nearer to it, hence less
            return (a, b) if shared[a] > shared[b] else (b, a)
        one, other = heads[a][1], heads[b][1]
        met = common(one[0], other[0], shared[a])
        rest = met * DIGEST
        first, second = one[0][rest : rest + DIGEST], other[0][rest : rest + DIGEST]
        win, lose = (a, b) if (first, one[1]) <= (second, other[1]) else (b, a)
        shared[lose] = met
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    top = build(1) if k > 1 else 0
    while heads[top] is not None:
        yield shared[top], heads[top][1]
        heads[top] = next(runs[top], None)
        shared[top] = heads[top][0] if heads[top] else 0
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


class Node:
    """An open node; sums are of its own members and its finished children."""

    __slots__ = ("children", "ends", "key", "least", "leaves", "members", "saved", "size")

    def __init__(self, key: bytes, size: int):
        self.key, self.size, self.least, self.members, self.children, self.leaves, self.saved, self.ends = key, size, 2**63 - 1, 0, 0, 0, 0, []

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.members - 1) * self.size

    def take(self, child: Node) -> None:
        self.least = min(self.least, child.least)
        self.members += child.members
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


DONE = np.dtype([("open", bool), ("depth", np.int64), ("least", np.int64), ("members", np.int64), ("children", np.int64), ("leaves", np.int64), ("saved", np.int64), ("key", "V16"), ("ends", "V32")])


class Finished:
    """Finished nodes, children before parents, read backwards; beyond the memory in a temporary file."""

    def __init__(self, memory: int):
        self.most, self.held, self.file, self.blocks = max(1, memory // DONE.itemsize // 4), [], None, []

    def add(self, depth: int, node: Node, is_open: bool) -> None:
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).digest()
        self.held.append((is_open, depth, node.least, node.members, node.children, node.leaves, node.saved, node.key, ends))
        if len(self.held) >= self.most:
            self.file = self.file or tempfile.TemporaryFile(prefix="nodes-")
            self.file.write(np.array(self.held, DONE).tobytes())
            self.blocks.append(len(self.held))
            self.held = []

    def backwards(self) -> Iterator[np.ndarray]:
        yield np.array(self.held, DONE)[::-1]
        for i in range(len(self.blocks) - 1, -1, -1):
            self.file.seek(sum(self.blocks[:i]) * DONE.itemsize)
            yield np.frombuffer(self.file.read(self.blocks[i] * DONE.itemsize), DONE)[::-1]


ROOT = b"\0" * DIGEST
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
RANGES = f"{NODES}, range int, step int, size long, members string"
NAMES = [x.split()[0] for x in RANGES.split(", ")]


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, RANGES.split(", "), strict=True)], NAMES)


def walk_range(stream: Iterator[tuple[int, Entry]], number: int, memory: int) -> Iterator[list[tuple]]:
    """Rows of a range's finished nodes, and of those on its first and last path, as partial sums (range and step are theirs)."""
    done, stack, borders = Finished(memory), [], []
    first: list[Node] = []

    def border(node: Node, depth: int, step: int) -> tuple:
        return (node.least, depth, None, node.members, node.children, node.leaves, node.saved, None, node.key, None, number, step, node.size, ",".join(map(str, node.ends)))

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        is_open = depth < len(first) and first[depth] is node
        if is_open:
            borders.append(border(node, depth, 0))  # its parent is on the first path too, which sums it later
        else:
            node.close()
            stack[-1].take(node)
        done.add(depth, node, is_open)

    for shared, (path, conv, sizes) in stream:
        if not stack:
            stack.append(Node(ROOT, 0))
        while len(stack) > shared + 1:
            pop()
        for depth in range(len(stack), len(sizes) + 1):
            key = hashlib.blake2b(stack[-1].key + path[(depth - 1) * DIGEST : depth * DIGEST], digest_size=DIGEST).digest()
            stack.append(Node(key, sizes[depth - 1]))
        stack[-1].members += 1
        stack[-1].least = min(stack[-1].least, conv)
        stack[-1].ends.append(conv)
        first = first or list(stack)
    if not stack:
        return
    shared = sum(a is b for a, b in zip(first, stack, strict=False))
    borders += [border(node, depth, 0 if depth < shared else 1) for depth, node in enumerate(stack)]
    yield borders
    at: dict[int, tuple[int | None, bytes | None]] = {depth: (None, node.key) for depth, node in enumerate(stack)}
    for block in done.backwards():
        rows = []
        for is_open, depth, least, members, children, leaves, saved, key, ends in block.tolist():
            if not is_open:
                parent, parent_key = at[depth - 1]
                rows.append((least, depth, parent, members, children, leaves, saved, ends.hex(), None, parent_key, None, None, None, None))
            at[depth] = (None, key) if is_open else (least, None)
        yield rows


def walk_borders(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of the nodes that ranges have in parts, from theirs by range, step and depth."""
    stack: list[Node] = []
    out: list[tuple] = []

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        node.close()
        if stack:
            stack[-1].take(node)
        out.append((node.least, depth, None, node.members, node.children, node.leaves, node.saved, node.ends[0].hexdigest() if node.ends else EMPTY, node.key, stack[-1].key if stack else None, None, None, None, None))

    for least, depth, members, children, leaves, saved, key, size, ends in rows:
        while len(stack) > depth and stack[depth].key != key:
            pop()
        if len(stack) == depth:
            stack.append(Node(key, size))
        node = stack[depth]
        node.least = min(node.least, least)
        node.members += members
        node.children += children
        node.leaves += leaves
        node.saved += saved
        if ends:
            if node.ends:
                node.ends[0].update(b",")
            else:
                node.ends.append(hashlib.sha256())
            node.ends[0].update(ends.encode())
        if len(out) > 1 << 12:
            yield out
            out = []
    while stack:
        pop()
    yield out


def trie(sequences: DataFrame, memory: int = MEMORY, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of all prefixes of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(sequences.sparkSession, "prefixes")
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    held = scratch.table(sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "sequences")
    total = held.agg(F.sum(F.size("sizes") + 8)).first()[0] or 0
    parts = max(8, int(total // range_turns))

    def ranged(batches):
        runs = Runs(memory)
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.add(*entry)
        for rows in walk_range(runs.merged(), TaskContext.get().partitionId(), memory):
            for low in range(0, len(rows), 1 << 14):
                yield rows_of(rows[low : low + (1 << 14)])

    def bordered(batches):
        for rows in walk_borders(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            yield rows_of(rows)

    dealt = held.repartitionByRange(parts, "path", "conv_id").select("path", "conv_id", "sizes")
    found = scratch.table(dealt.mapInArrow(released(ranged), RANGES), "ranges")
    borders = found.where("range is not null").repartition(1).sortWithinPartitions("range", "step", "depth")
    borders = borders.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "key", "size", "members").mapInArrow(released(bordered), RANGES)
    borders = scratch.table(borders.select(*(x.split()[0] for x in NODES.split(", "))), "borders")
    done = found.where("range is null").select(*borders.columns)
    parents = borders.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    orphans = done.where("parent_key is not null").unionByName(borders).join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("parent"))
    names = borders.columns[:8]
    return done.where("parent_key is null").select(*names).unionByName(orphans.select(*names))
