"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space runs become one space. An item with an error budget of k is
cut into k + 1 pieces: a passage within k edits holds one of them unchanged. One automaton finds all pieces of a block of
items; the windows around an item's hits are merged where they overlap, and Myers' bit-parallel distance finds the closest
match in each. A second pass, from that match's end backwards, finds where it starts.

Defined cases: null and empty texts match nothing; items without a word are left out; equal items are all reported; a
text shorter than the item matches only within the budget. The items are taken in blocks of a stated number of bytes, so
neither the driver nor a worker holds more of them at once.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_blocks, raw_text, released, texts

RATE = 0.08  # edits allowed per character of an item
ITEM_BYTES = 4 << 20
RUN = re.compile(r"\s+")
SCHEMA = "item_id long, distance long, item_chars long, match_start long, match_end long"


def normal(text: str) -> str:
    return RUN.sub(" ", text.lower()).strip()


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Distance of one pattern to substrings of a window, a column of the matrix per machine step of whole-integer logic."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.full, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, window: str, k: int) -> tuple[int, int] | None:
        """(distance, end in the window) of the closest substring within k edits; the leftmost end of the least distance."""
        plus, minus, score, found = self.full, 0, self.n, None
        full, top, peq = self.full, self.top, self.peq.get
        for at, c in enumerate(window, 1):
            equal = peq(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score <= k and (found is None or score < found[0]):
                found = (score, at)
        return found


    def anchored(self, window: str, distance: int) -> int:
        """The fewest characters of the window, from its first on, that are at a distance from the whole pattern."""
        plus, minus, score = self.full, 0, self.n
        if score == distance:
            return 0
        full, top, peq = self.full, self.top, self.peq.get
        for at, c in enumerate(window, 1):
            equal = peq(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1 | 1) & full  # characters before the match's first cost one each
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score == distance:
                return at
        raise ValueError("no such distance")


class Matcher:
    """A block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, n, budget(n, rate)) for i, t in items if (n := normal(t or ""))]
        self.automaton = ahocorasick.Automaton()
        spots: dict[str, list[tuple[int, int]]] = {}
        for which, (_, item, k) in enumerate(self.items):
            for offset, piece in pieces(item, k):
                spots.setdefault(piece, []).append((which, offset))
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.myers: dict[int, tuple[Myers, Myers]] = {}

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, item's length, start, end) of the closest match of each item found."""
        if not self.items or not (text := normal(text)):
            return []
        begins: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for which, offset in where:
                begins.setdefault(which, set()).add(end + 1 - length - offset)
        out = []
        for which, starts in begins.items():
            item_id, item, k = self.items[which]
            n, starts = len(item), sorted(starts)
            whole = next((s for s in starts if s >= 0 and text.startswith(item, s)), None)
            if whole is not None:
                out.append((item_id, 0, n, whole, whole + n))
                continue
            best, windows = None, []
            for start in starts if k else ():
                low, high = max(0, start - k), start + n + k
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            for low, high in windows:
                if which not in self.myers:
                    self.myers[which] = Myers(item), Myers(item[::-1])
                found = self.myers[which][0].best(text[low:high], k)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], low + found[1])
            if best is not None:
                distance, end = best
                back = self.myers[which][1].anchored(text[max(0, end - n - k) : end][::-1], distance)
                out.append((item_id, distance, n, end - back, end))
        return sorted(out)


def item_blocks(benchmark: DataFrame, rate: float):
    """Matchers of blocks of the benchmark, each of about ITEM_BYTES."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // ITEM_BYTES) + 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted((r.item_id if r.item_id is not None else -1, r.text) for r in part.collect())


class Held:
    """The last matcher a worker built."""

    key, matcher = None, None

    @classmethod
    def of(cls, items: list[tuple[int, str]], rate: float) -> Matcher:
        key = (hash(tuple(items)), rate)
        if cls.key != key:
            cls.key, cls.matcher = key, Matcher(items, rate)
        return cls.matcher


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per text and item that it holds within the item's budget; positions are those of the normalised text."""
    out = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item_id", "distance", "item_chars", "match_start", "match_end"]
    for items in item_blocks(benchmark, rate):
        held = docs.sparkSession.sparkContext.broadcast(items)  # ITEM_BYTES of text and an id each

        def run(batches, held=held):
            matcher = Held.of(held.value, rate)
            for batch in batches:
                rows, at, base = [], [], 0
                _, offsets = raw_text(batch.column(1))
                for low, high in doc_blocks(offsets):
                    for base, text in enumerate(texts(batch.column(1).slice(low, high - low)), low):
                        found = matcher.matches(text)
                        rows += found
                        at += [base] * len(found)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names)

        part = docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows whose texts hold no test item, all columns kept."""
    spot = docs.columns.index("text")
    for items in item_blocks(benchmark, rate):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            matcher = Held.of(held.value, rate)
            for batch in batches:
                keep = []
                _, offsets = raw_text(batch.column(spot))
                for low, high in doc_blocks(offsets):
                    keep += [not matcher.matches(t) for t in texts(batch.column(spot).slice(low, high - low))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs
