"""Byte-level BPE encoding and decoding.

A segment tree over byte positions holds, at its root, the smallest (pair rank, position): the leftmost pair of least
rank. A merge rewrites the leaves of the merged position, of its live right neighbour and of its live left neighbour, so
it costs a logarithmic number of node updates. Many pieces of one width share a NumPy forest of such trees, one step
merging one pair in each; long pieces take the same steps one by one in lists.

Defined cases: a null or empty text has no ids; a piece that is itself in the vocabulary is that one id, as the tiktoken
library has it; bytes missing from the vocabulary raise KeyError. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_blocks, raw_text, released, texts

MEMO = 1 << 16  # pieces a worker remembers from block to block
BLOCK = 1 << 20
WIDE = 256  # bytes from which a piece is merged alone
NONE = np.int64(1 << 40)

# Letters, numbers and white space below U+0250, by Unicode's categories.
LETTER, NUMBER, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
PLAIN = re.compile(r"[\x00-ɏ]*")


class Pattern:
    """The matches of a public split pattern. Texts below U+0250 take an equal pattern of plain classes, which is faster."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{BLANK}{LETTER}{NUMBER}]").replace(r"\p{L}", f"[{LETTER}]").replace(r"\p{N}", f"[{NUMBER}]")
        self.plain = re.compile(plain.replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]"))

    def pieces(self, text: str):
        pattern = self.plain if PLAIN.fullmatch(text) else self.full
        if len(text) < 1 << 22:
            return [pattern.findall(text)]
        return ([m.group() for m in some] for some in itertools.batched(pattern.finditer(text), 1 << 18))


class Bpe:
    """A vocabulary of ranks, and the pieces this worker has met."""

    held: dict[tuple[str, str], Bpe] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Bpe:
        if (path, pattern) not in cls.held:
            gc.set_threshold(200_000, 50, 50)  # millions of short-lived strings, no cycles
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cls.held[path, pattern] = cls(ranks, pattern)
        return cls.held[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.memo, self.seen = ranks, Pattern(pattern), {}, set()
        self.token = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        self.pairs = pairs
        self.packed = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        self.bytes_rank = np.full((256, 256), NONE, np.int64)
        for i in range(256):
            for j in range(256):
                self.bytes_rank[i, j] = ranks.get(bytes([i, j]), NONE)
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it doesn't merge or a side is missing (below 0)."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of at most `width` bytes (a power of two)."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # One slot before and one after each row stand for missing neighbours.
        w = width + 2
        ids = np.full(n * w, -1, np.int64)
        ids[row * w + column + 1] = self.byte[flat]
        if len(flat) and (self.byte[flat] < 0).any():
            raise KeyError("a byte is missing from the vocabulary")
        after = np.tile(np.arange(1, w + 1, dtype=np.int64), n)
        before = np.tile(np.arange(-1, w - 1, dtype=np.int64), n)
        tree = np.full((n, 2 * width), NONE, np.int64)
        two = np.flatnonzero(column[1:] > 0)
        r = self.bytes_rank[flat[two], flat[two + 1]]
        tree[row[two], width + column[two]] = np.where(r < NONE, r * width + column[two], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.reshape(-1)
        live = np.arange(n)
        while True:
            root = tree[live * 2 * width + 1]
            going = root < NONE
            if not going.all():
                live, root = live[going], root[going]
            if not len(live):
                break
            at, merged = root % width + 1, root // width
            base = live * w
            gone = after[base + at]
            right = after[base + gone]
            ids[base + at] = merged
            ids[base + gone] = -2
            after[base + at] = right
            before[base + np.minimum(right, w - 1)] = at
            left = before[base + at]
            r = self.rank(merged, ids[base + np.minimum(right, w - 1)])
            l = self.rank(ids[base + left], merged)
            top = live * 2 * width + width
            tree[top + gone - 1] = NONE
            tree[top + at - 1] = np.where(r < NONE, r * width + at - 1, NONE)
            some = left > 0
            tree[(top + left - 1)[some]] = np.where(l < NONE, l * width + left - 1, NONE)[some]
            for spot in (gone - 1, at - 1, np.maximum(left - 1, 0)):
                node, own = (spot + width) >> 1, live * 2 * width
                while node[0]:
                    tree[own + node] = np.minimum(tree[own + 2 * node], tree[own + 2 * node + 1])
                    node = node >> 1
        keep = ids.reshape(n, w) >= 0
        packed = ids.reshape(n, w)[keep].astype("<u4").tobytes()
        ends = (4 * np.cumsum(keep.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in itertools.pairwise([0, *ends])]

    def merge_long(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        if min(ids) < 0:
            raise KeyError("a byte is missing from the vocabulary")
        pairs, none = self.pairs, (1 << 60, 0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            r = pairs.get(ids[i] << 24 | ids[j]) if j < n else None
            return none if r is None else (r, i)

        def put(i: int, value: tuple[int, int]) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a <= b else b

        for i in range(n - 1):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            ids[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece, packed as little-endian unsigned 32-bit integers."""
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = dict(zip(pieces, map(self.packed.get, coded), strict=True))
        rest = [(p, b) for p, b in zip(pieces, coded, strict=True) if out[p] is None]
        lengths = np.fromiter((len(b) for _, b in rest), np.int64, len(rest))
        for width in (2 << i for i in range(WIDE.bit_length())):
            some = np.flatnonzero((lengths <= width) & (lengths > width // 2 if width > 2 else lengths > 0) & (lengths <= WIDE)).tolist()
            step = max(1, (1 << 19) // width)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                out.update(zip([rest[j][0] for j in part], self.merge_many([rest[j][1] for j in part], width), strict=True))
        for j in np.flatnonzero(lengths > WIDE).tolist():
            out[rest[j][0]] = self.merge_long(rest[j][1]).astype("<u4").tobytes()
        return out

    def known(self, fresh: set[str]) -> dict[str, bytes]:
        """Ids of all these pieces and more. What two blocks in a row hold stays in the memo."""
        out = self.learn(list(fresh - self.memo.keys()))
        if len(self.memo) < MEMO:
            self.memo.update({p: out[p] for p in self.seen & out.keys()})
        self.seen = set(out) if len(out) < 4 * MEMO else set()
        out.update(self.memo)
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.pattern.pieces(t) for t in batch]
        if all(isinstance(s, list) for s in split):
            lists = [s[0] for s in split]
            get = self.known(set().union(*lists)).__getitem__
            return [b"".join(map(get, s)) for s in lists]
        out = []
        for s in split:
            parts = []
            for some in s:
                parts.append(b"".join(map(self.known(set(some)).__getitem__, some)))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoded(column: pa.Array, bpe: Bpe):
    _, offsets = raw_text(column)
    for low, high in doc_blocks(offsets, BLOCK):
        yield from bpe.encode(texts(column.slice(low, high - low)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text: (id_col, ids array<int>)."""

    def run(batches):
        bpe = Bpe.of(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in _encoded(batch.column(1), bpe)]
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each list of ids: (id_col, decoded binary); a null list gives no bytes."""

    def run(batches):
        bpe = Bpe.of(path, pattern)
        for batch in batches:
            out = [b"".join(map(bpe.token.__getitem__, x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(released(run), f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text, decodes its ids, and keeps their number and both digests."""

    def run(batches):
        bpe = Bpe.of(path, pattern)
        for batch in batches:
            count, ids, back = [], [], []
            for packed in _encoded(batch.column(1), bpe):
                count.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids of each text, and whether they decode to its bytes."""

    def run(batches):
        bpe = Bpe.of(path, pattern)
        for batch in batches:
            column = batch.column(1)
            data, offsets = raw_text(column)
            for low, high in doc_blocks(offsets, BLOCK):
                packed = bpe.encode(texts(column.slice(low, high - low)))
                same = [bpe.decode(x) == data[offsets[i] : offsets[i + 1]].tobytes() for i, x in enumerate(packed, low)]
                ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean")
