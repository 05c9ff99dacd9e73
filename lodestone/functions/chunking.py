"""Chunkers: fixed slices in SQL; content-defined ones, paragraph packing and format-aware splitting in Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import pieces, released

# The fingerprint's polynomial and window.
POLYNOMIAL, WINDOW, U64 = 0x3DA3358B4DC173, 64, (1 << 64) - 1
AT_ONCE = 1 << 20  # bytes whose fingerprints are made at once


@dataclass(frozen=True)
class Sizes:
    least: int = 64 << 10
    target: int = 256 << 10
    most: int = 1 << 20

    def __post_init__(self):
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("sizes must rise from least over target to most")


SMALL, DEFAULT, LARGE = Sizes(1 << 10, 4 << 10, 16 << 10), Sizes(), Sizes(256 << 10, 1 << 20, 4 << 20)
CHUNK = "idx int, offset long, size int, cid string, data binary"


def fixed(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(doc_id, idx, offset, size, chunk): slices of `size` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda s: F.struct(s.cast("long").alias("offset"), F.substring(F.col(text), s + 1, F.lit(size)).alias("chunk")))
    out = docs.where(F.length(text) > 0).select("doc_id", F.posexplode(cut).alias("idx", "c"))
    return out.select("doc_id", F.col("idx").cast("long").alias("idx"), "c.offset", F.length("c.chunk").cast("long").alias("size"), "c.chunk")


class Rabin:
    """Cuts where a rolling fingerprint's low bits are zero: a table step a byte, whose window is kept by removal of the byte that leaves."""

    def __init__(self, sizes: Sizes, polynomial: int = POLYNOMIAL):
        self.sizes, self.mask = sizes, (1 << (sizes.target.bit_length() - 1)) - 1
        self.enter = [self._shift(i << 55, 8, polynomial) for i in range(256)]
        self.leave = []
        for i in range(256):
            h = 0
            for bit in range(7, -1, -1):
                h = self._shift(h, 1, polynomial) ^ (polynomial if i >> bit & 1 else 0)
            self.leave.append(self._shift(h, 8 * (WINDOW - 1), polynomial))

    @staticmethod
    def _shift(h: int, times: int, polynomial: int) -> int:
        for _ in range(times):
            h = ((h << 1) & U64) ^ (polynomial if h >> 63 else 0)
        return h

    def cuts_plain(self, data: bytes) -> list[int]:
        """Ends of the chunks, byte by byte."""
        s, out, start, n = self.sizes, [], 0, len(data)
        while start < n:
            h, end = 0, min(n, start + s.most)
            for at in range(start, end):
                if at - start >= WINDOW:
                    h ^= self.leave[data[at - WINDOW]]
                h = ((h << 8) & U64) ^ self.enter[h >> 56] ^ data[at]
                if at + 1 - start >= s.least and h & self.mask == 0:
                    end = at + 1
                    break
            out.append(end)
            start = end
        return out

    def cuts(self, data: bytes) -> list[int]:
        return self.cuts_of([data])[0]

    def cuts_of(self, texts: list[bytes]) -> list[list[int]]:
        """The ends of the chunks of each text. A hash depends on its chunk's bytes alone, so a long text goes on from any cut."""
        if self.sizes.least < WINDOW or self.mask >= 1 << 32:
            return [self.cuts_plain(x) for x in texts]
        out: list[list[int]] = [[] for _ in texts]
        steps, span, waiting, size = steps_of(self.sizes), max(AT_ONCE, 2 * self.sizes.most), [], 0

        def together() -> None:
            found = steps.cuts([texts[i][start:] for i, start in waiting]) if waiting else []
            for (i, start), ends in zip(waiting, found, strict=True):
                out[i] += [start + e for e in ends]
            waiting.clear()

        for i, text in enumerate(texts):
            start = 0
            while len(text) - start > span:
                ends = steps.cuts([text[start : start + span]])[0][:-1]  # the last one may go on
                out[i] += [start + e for e in ends]
                start += ends[-1]
            if len(text) - start <= self.sizes.least:
                out[i] += [len(text)] if text else []
                continue
            waiting.append((i, start))
            size += len(text) - start
            if size >= AT_ONCE:
                together()
                size = 0
        together()
        return out


class Steps:
    """The fingerprint's cuts, many bytes at once.

    A step is linear over bits, so a chunk's hash is that of the whole text so far, less what the bytes before the chunk
    have left in it: a start value that takes the same steps. The whole text's hashes are made in pieces of LANE bytes side
    by side, whose ends meet in a scan that doubles.
    """

    LANE, AHEAD = 128, 1024  # bytes of a piece, hashes of a chunk that are looked at together

    def __init__(self, sizes: Sizes):
        rabin = Rabin(sizes)
        self.sizes, self.mask = sizes, np.uint32(rabin.mask)
        self.enter, self.leave = np.array(rabin.enter, np.uint64), np.array(rabin.leave, np.uint64)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        powers = [bits]
        for _ in range(max(self.LANE, self.AHEAD)):
            powers.append(self._step(powers[-1]))
        self.lane = self._bytes(np.stack(powers[1 : self.LANE + 1], axis=1))  # after each byte of a piece, what its start has become
        self.low = self.lane.astype(np.uint32)
        self.ahead = self._bytes(np.stack(powers[: self.AHEAD], axis=1).astype(np.uint32))
        self.doubles = [self._bytes(powers[self.LANE][:, None])[:, :, 0]]
        self.window = self._bytes(powers[WINDOW][:, None])[:, :, 0]
        self.jump = self._bytes(powers[self.AHEAD][:, None])[:, :, 0]
        first = bits
        for _ in range(sizes.least - WINDOW):
            first = self._step(first)
        self.first = self._bytes(first[:, None])[:, :, 0]
        out = [self._step(self.leave)]
        for _ in range(WINDOW - 1):
            out.append(self._step(out[-1]))
        self.left = np.stack(out[::-1])  # by a byte's place in the window before a chunk: what its removal would be at the window's end

    def _step(self, h: np.ndarray) -> np.ndarray:
        return (h << np.uint64(8)) ^ self.enter[h >> np.uint64(56)]

    @staticmethod
    def _bytes(of_bits: np.ndarray) -> np.ndarray:
        """(8, 256, n): a linear map's values for each byte of a hash, from (64, n) of its bits."""
        out = np.zeros((8, 256, of_bits.shape[1]), of_bits.dtype)
        for bit in range(8):
            out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] ^ of_bits[bit::8][:, None]
        return out

    @staticmethod
    def _mapped(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = table[0][h & np.uint64(255)]
        for byte in range(1, 8):
            out = out ^ table[byte][h >> np.uint64(8 * byte) & np.uint64(255)]
        return out

    def cuts(self, texts: list[bytes]) -> list[list[int]]:
        size = np.array([len(x) for x in texts])
        rows = -(-size // self.LANE)  # pieces of a text
        base = np.concatenate(([0], np.cumsum(rows)))
        data = np.zeros(base[-1] * self.LANE, np.uint8)
        for text, at in zip(texts, (base * self.LANE).tolist(), strict=False):
            data[at : at + len(text)] = np.frombuffer(text, np.uint8)
        gone = np.zeros_like(data)
        gone[WINDOW:] = data[:-WINDOW]
        gone.reshape(-1, self.LANE)[base[:-1], :WINDOW] = 0
        fresh = (self._step(self.leave)[gone] ^ data).reshape(-1, self.LANE).T.copy()
        h = np.zeros(base[-1], np.uint64)
        for byte in fresh:  # each piece from zero on; the bytes' values give way to the hashes
            h = self._step(h) ^ byte
            byte[:] = h
        place = np.arange(base[-1]) - np.repeat(base[:-1], rows)
        reach, k = 1, 0
        while reach < rows.max():
            if k == len(self.doubles):
                last = self.doubles[-1]
                self.doubles.append(self._bytes(self._mapped(last, last[np.arange(64) // 8, 1 << np.arange(64) % 8])[:, None])[:, :, 0])
            some = np.flatnonzero(place >= reach)
            h[some] ^= self._mapped(self.doubles[k], h[some - reach])
            reach, k = 2 * reach, k + 1
        before = np.concatenate((np.zeros(1, np.uint64), h[:-1]))
        before[base[:-1]] = 0
        low = fresh.astype(np.uint32).T ^ self._mapped(self.low, before)
        low = low.ravel()
        return [self._text(fresh, low, before, data, int(b), n) for b, n in zip(base, size.tolist(), strict=False)]

    def _text(self, fresh: np.ndarray, low: np.ndarray, before: np.ndarray, data: np.ndarray, base: int, n: int) -> list[int]:
        s, out, start, top = self.sizes, [], 0, base * self.LANE
        byte, shift = np.arange(8), np.arange(0, 64, 8).astype(np.uint64)
        of = lambda h: (h >> shift & np.uint64(255)).astype(np.int64)
        while start < n:
            end = min(n, start + s.most)
            if start + s.least < end:
                held = np.uint64(0)
                if start:
                    row, j = base + (start - 1) // self.LANE, (start - 1) % self.LANE
                    held = fresh[j, row] ^ np.bitwise_xor.reduce(self.lane[byte, of(before[row]), j])
                    held = np.bitwise_xor.reduce(self.window[byte, of(held)])
                    known = min(WINDOW, start)
                    held ^= np.bitwise_xor.reduce(self.left[np.arange(WINDOW - known, WINDOW), data[top + start - known : top + start]])
                    held = np.bitwise_xor.reduce(self.first[byte, of(held)])
                for at in range(start + s.least - 1, end, self.AHEAD):
                    some = low[top + at : top + min(at + self.AHEAD, end)]
                    if start:
                        some = some ^ np.bitwise_xor.reduce(self.ahead[byte, of(held), : len(some)], axis=0)
                        held = np.bitwise_xor.reduce(self.jump[byte, of(held)])
                    hit = some & self.mask == 0
                    first = int(hit.argmax())
                    if hit[first]:
                        end = at + first + 1
                        break
            out.append(end)
            start = end
        return out


@functools.lru_cache(maxsize=4)
def steps_of(sizes: Sizes) -> Steps:
    return Steps(sizes)


class FastCdc:
    """Gear hashing with a stricter mask before the target size and a looser one after it."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        seeds = [hashlib.sha256(bytes([i])).digest() for i in range(256)]
        self.gear = [int.from_bytes(s[:8], "little") for s in seeds]
        bits = sizes.target.bit_length() - 1
        self.strict, self.loose = ((1 << b) - 1 << (64 - b) for b in (bits + 1, max(1, bits - 1)))

    def cuts_of(self, texts: list[bytes]) -> list[list[int]]:
        return [self.cuts(x) for x in texts]

    def cuts_plain(self, data: bytes) -> list[int]:
        s, out, start, n = self.sizes, [], 0, len(data)
        while start < n:
            end, h = min(n, start + s.most), 0
            for at in range(start + s.least, end):
                h = ((h << 1) + self.gear[data[at]]) & U64
                if h & (self.strict if at - start < s.target else self.loose) == 0:
                    end = at + 1
                    break
            out.append(end)
            start = end
        return out

    def cuts(self, data: bytes) -> list[int]:
        """The same by blocks: a hash reaches 64 bytes back, so all are summed at once, doubling; only the walk over the cuts goes on one by one."""
        s, out, start, n = self.sizes, [], 0, len(data)
        if n <= s.least:
            return [n] if n else []
        whole = np.array(self.gear, np.uint64)[np.frombuffer(data, np.uint8)]
        for reach in (1, 2, 4, 8, 16, 32):
            if n > reach:
                whole[reach:] += whole[:-reach].copy() << np.uint64(reach)
        strict, loose = (np.flatnonzero(whole & np.uint64(m) == 0) for m in (self.strict, self.loose))
        while start < n:
            end, h, at = min(n, start + s.most), 0, start + s.least
            warm = min(end, at + 63)
            while at < warm:  # the first hashes of a chunk know its own bytes alone
                h = ((h << 1) + self.gear[data[at]]) & U64
                at += 1
                if h & (self.strict if at - 1 - start < s.target else self.loose) == 0:
                    end = at
                    break
            else:
                turn = start + s.target
                for spots, low, high in ((strict, at, min(end, turn)), (loose, max(at, turn), end)):
                    k = np.searchsorted(spots, low)
                    if low < high and k < len(spots) and spots[k] < high:
                        end = int(spots[k]) + 1
                        break
            out.append(end)
            start = end
        return out


def streamed(buffers: Iterable[bytes], cutter: Rabin | FastCdc) -> Iterator[bytes]:
    """The chunks of a stream of buffers, those of its bytes as a whole; about two of the largest chunks are held at once."""
    held, most = bytearray(), cutter.sizes.most
    for buffer in buffers:
        held += buffer
        if len(held) >= 2 * most:
            start = 0
            for end in cutter.cuts(bytes(held)):
                if end == len(held) and end - start < most:
                    break  # it may go on
                yield bytes(held[start:end])
                start = end
            del held[:start]
    start = 0
    for end in cutter.cuts(bytes(held)):
        yield bytes(held[start:end])
        start = end


class Streaming:
    """A chunker of streams by either way of cutting."""

    def __init__(self, cutter: Rabin | FastCdc):
        self.cutter = cutter

    def chunks(self, buffers: Iterable[bytes]) -> Iterator[bytes]:
        return streamed(buffers, self.cutter)


def paragraphs(text: str, least: int, most: int, separator: str = "\n\n") -> list[str]:
    """Trimmed paragraphs packed up to `most` UTF-8 bytes; packs below `least` are dropped, a larger paragraph stays whole."""
    out: list[str] = []
    pack: list[str] = []
    size = 0

    def close(floor: int) -> None:
        nonlocal size
        if pack and size >= floor:
            out.append("\n\n".join(pack))
        pack.clear()
        size = 0

    for part in filter(None, map(str.strip, text.split(separator))):
        width = len(part.encode())
        if pack and size + width + 2 > most:
            close(least)
        size += width + (2 if pack else 0)
        pack.append(part)
        if size >= most:
            close(0)
    close(max(least, 1))
    return out


def smart(text: str, extension: str, least: int, most: int) -> list[str]:
    """By kind of file: Markdown at headings, code at blank lines before unindented ones, other text at paragraphs."""
    if extension in ("md", "markdown", "mdx"):
        parts = re.split(r"(?m)^(?=#{1,6} )", text)
    elif extension and extension not in ("txt", "text"):
        parts = re.split(r"\n\s*\n(?=\S)", text)
    else:
        parts = text.split("\n\n")
    return paragraphs("\0".join(parts), least, most, "\0")


def content_defined(docs: DataFrame, chunker: str, sizes: Sizes = DEFAULT, data: str = "data") -> DataFrame:
    """(doc_id, idx, offset, size, cid, data) by "rabin" or "fastcdc"."""

    def run(batches):
        cutter = Rabin(sizes) if chunker == "rabin" else FastCdc(sizes)
        for batch in batches:
            for piece in pieces(batch, 1):
                texts = [bytes(x or b"") for x in piece.column(1).to_pylist()]
                ends = cutter.cuts_of(texts)
                starts = [[0, *e[:-1]] if e else [] for e in ends]
                parts = [x[a:b] for x, low, high in zip(texts, starts, ends, strict=True) for a, b in zip(low, high, strict=True)]
                n = np.array([len(e) for e in ends], np.int64)
                idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                columns = [piece.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(idx.astype(np.int32)), pa.array([a for x in starts for a in x], pa.int64()), pa.array([len(p) for p in parts], pa.int32())]
                columns += [pa.array(["01551220" + hashlib.sha256(p).hexdigest() for p in parts], pa.string()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "idx", "offset", "size", "cid", "data"])

    return docs.select("doc_id", data).mapInArrow(released(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {CHUNK}")


def packed(docs: DataFrame, least: int, most: int, separator: str = "\n\n", extension: str | None = None) -> DataFrame:
    """(doc_id, idx, chunk) by paragraph packing, or by the kind of file where an extension is given."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                docs_, idx, out = [], [], []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    parts = paragraphs(text or "", least, most, separator) if extension is None else smart(text or "", extension, least, most)
                    docs_ += [doc] * len(parts)
                    idx += range(len(parts))
                    out += parts
                yield pa.RecordBatch.from_arrays([pa.array(docs_, batch.schema.field(0).type), pa.array(idx, pa.int64()), pa.array(out, pa.string())], ["doc_id", "idx", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {dict(docs.dtypes)['doc_id']}, idx long, chunk string")


def effectiveness(first: DataFrame, second: DataFrame) -> DataFrame:
    """(first_chunks, second_chunks, common_chunks): the distinct chunks (cid) of two chunkings, and those that both have."""
    both = first.select("cid", F.lit(1).alias("side")).unionByName(second.select("cid", F.lit(2).alias("side"))).groupBy("cid").agg(F.bit_or("side").alias("sides"))
    return both.agg(F.count_if(F.col("sides") != 2).alias("first_chunks"), F.count_if(F.col("sides") != 1).alias("second_chunks"), F.count_if(F.col("sides") == 3).alias("common_chunks"))
