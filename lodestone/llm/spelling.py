"""Spelling variants: words one code point apart, found by walking compact tries with each word's distance-one automaton.

1. Tasks count words, each one's changed occurrences included, in a bounded table that is sent on when full; Spark adds up.
2. The vocabulary is dealt out by ranges of words. A task packs its range into tries of at most SHARD_NODES nodes: each
   node's letter, its children's place and its word's count, children side by side in order.
3. Lots of LOT tries are broadcast in turn, so a broadcast's size is bounded (13 bytes a node), and every word's automaton
   is walked through each, depth first: along the word itself without an edit, and from each node there with one edit into
   the rest, which must then match letter by letter. A trie without a common prefix is left at its root.
4. A task sends one row a word and lot: how many accepting neighbours, and the best. These are added up, and the best forms
   are followed to their last by doubling.

Defined cases: a null text holds no words; a null doc_id counts as the empty string in a run's checksum; repeated rows
count each time; ties of forms go to the smallest word in code-point order; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_blocks, raw_text, released

SHARD_NODES, LOT, HELD_WORDS, TASK_WORDS = 1 << 18, 16, 1 << 18, 1 << 14
RUN = re.compile("[a-zÀ-ÿ]+")  # A-Z are lower case by then


def counted(docs: DataFrame, shortest: int, every: int) -> DataFrame:
    """(word, n): occurrences of each word of `shortest` code points or more, where each run whose checksum `every` divides loses a code point."""

    def sent(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            data, offsets = raw_text(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                began = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                text = data[offsets[i] : offsets[i + 1]].tobytes().lower().decode()
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) >= shortest:
                        h = zlib.crc32(word.encode(), began)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        total[word] += n
                if len(total) > HELD_WORDS:
                    yield sent(total)
                    total.clear()
        yield sent(total)

    return docs.select("doc_id", "text").mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Words of one byte a letter, breadth first: node k has the letter labels[k], the children start[k] to start[k + 1], and the count of the word that ends there, or 0."""

    def __init__(self, labels: bytes, start: array, counts: array):
        self.labels, self.start, self.counts = labels, start, counts
        self.ways: dict[int, list[tuple[int, int]]] = {}

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        """From sorted distinct words."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        shared = np.array([0, *(shared_prefix(a, b) for a, b in zip(words, words[1:], strict=False))], np.int64)
        fresh = size - shared
        word = np.repeat(np.arange(n), fresh)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(shared, fresh) + 1
        letters = np.frombuffer(b"".join(w[s:] for w, s in zip(words, shared.tolist(), strict=True)), np.uint8)
        key = depth * n + word
        order = np.argsort(key)
        key, depth, word = np.append(0, key[order]), depth[order], word[order]
        parent = np.searchsorted(key, (depth - 1) * n + word, "right") - 1  # the last node above that began no later
        parent[depth == 1] = 0
        children = np.bincount(parent, minlength=len(key))
        start = np.append(1, 1 + np.cumsum(children)).astype(np.int32)
        ends = np.zeros(len(key), np.int64)
        ends[np.searchsorted(key, size * n + np.arange(n))] = counts
        return cls(b"\0" + letters[order].tobytes(), array("i", start.tobytes()), array("q", ends.tobytes()))

    def packed(self) -> bytes:
        return np.int64(len(self.labels)).tobytes() + self.labels + self.start.tobytes() + self.counts.tobytes()

    @classmethod
    def unpacked(cls, held: bytes) -> Trie:
        n = int.from_bytes(held[:8], "little")
        return cls(held[8 : 8 + n], array("i", held[8 + n : 12 + 5 * n]), array("q", held[12 + 5 * n :]))

    def near(self, word: bytes) -> dict[bytes, int]:
        """The words one letter apart, each with its count."""
        labels, start, counts, find, n = self.labels, self.start, self.counts, self.labels.find, len(word)
        out: dict[bytes, int] = {}

        def rest(node: int, at: int) -> int:
            """The count of the word that continues from a node as `word` does from a letter on."""
            while at < n:
                node = find(word[at : at + 1], start[node], start[node + 1])
                if node < 0:
                    return 0
                at += 1
            return counts[node]

        node = 0
        for i in range(n):
            low, high = start[node], start[node + 1]
            own, after = word[i], word[i + 1] if i + 1 < n else -1
            if after != own and (count := rest(node, i + 1)):  # the letter goes; of a run of one letter the last
                out[word[:i] + word[i + 1 :]] = count
            for child, then in self.leading(node, own):  # a letter comes before it; one before its like is the same word as one after it
                if labels[child] != own and (count := rest(then, i + 1)):
                    out[word[:i] + labels[child : child + 1] + word[i:]] = count
            if after >= 0:  # another letter in its place
                for child, then in self.leading(node, after):
                    if labels[child] != own and (count := rest(then, i + 2)):
                        out[word[:i] + labels[child : child + 1] + word[i + 1 :]] = count
            else:
                for child in range(low, high):
                    if labels[child] != own and counts[child]:
                        out[word[:i] + labels[child : child + 1]] = counts[child]
            node = find(own, low, high)
            if node < 0:
                return out
        for child in range(start[node], start[node + 1]):  # a letter comes last
            if counts[child]:
                out[word + labels[child : child + 1]] = counts[child]
        return out

    def leading(self, node: int, letter: int) -> list[tuple[int, int]]:
        """(child, its child) by way of any letter and then a given one; kept for nodes with many children, of which there are few."""
        key = node << 8 | letter
        if (held := self.ways.get(key)) is None:
            low, high = self.start[node], self.start[node + 1]
            held = [(child, then) for child in range(low, high) if (then := self.labels.find(letter, self.start[child], self.start[child + 1])) >= 0]
            if high - low > 3:
                self.ways[key] = held
        return held


def shared_prefix(a: bytes, b: bytes) -> int:
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end
    at = 0
    while a[at] == b[at]:
        at += 1
    return at


def tries(words: DataFrame, parts: int, nodes: int) -> DataFrame:
    """(first, trie): the vocabulary as packed tries of `nodes` nodes at most, but for one longer word; first: its first word."""

    def run(batches):
        held: list[bytes] = []
        counts: list[int] = []
        size, before = 0, b""
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                word = word.encode("latin-1")
                more = len(word) - shared_prefix(before, word)
                if held and size + more > nodes:
                    yield sent(held, counts)
                    held, counts, size, more = [], [], 0, len(word)
                held.append(word)
                counts.append(n)
                size, before = size + more, word
        if held:
            yield sent(held, counts)

    def sent(held, counts):
        return pa.RecordBatch.from_arrays([pa.array([held[0].decode("latin-1")]), pa.array([Trie.of(held, counts).packed()], pa.binary())], ["first", "trie"])

    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").select("word", "n").mapInArrow(released(run), "first string, trie binary")


def searched(words: DataFrame, held: list[bytes]) -> DataFrame:
    """(word, n_near, form, form_n): of each word's neighbours in some tries their number and the best, where it has any."""
    shards = words.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        here = [Trie.unpacked(x) for x in shards.value]
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                word = text.encode("latin-1")
                near = {k: n for trie in here for k, n in trie.near(word).items()}
                if near:
                    best = max(near.values())
                    rows.append((text, len(near), min(k for k, n in near.items() if n == best).decode("latin-1"), best))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])

    return words.select("word").mapInArrow(released(run), "word string, n_near long, form string, form_n long")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, ratio: int = 2, nodes: int = SHARD_NODES, lot: int = LOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word: its neighbours' number, the most frequent one where it has `ratio` times the word's count, and the last of the forms from it on."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    words = scratch.table(counted(docs, shortest, every).where(F.col("n") >= least), "words")
    size, number = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)), F.count(F.lit(1))).first()
    shards = scratch.table(tries(words, max(1, int(size // (4 * nodes)) + 1), nodes), "tries")
    firsts = [r.first for r in shards.select(F.col("first")).orderBy("first").toLocalIterator()]
    dealt = scratch.table(words.select("word").repartition(max(8, number // TASK_WORDS)), "dealt")
    near = None
    for k in range(0, len(firsts), lot):
        until = firsts[k + lot : k + lot + 1]
        some = shards.where(F.col("first") >= firsts[k]).where(F.col("first") < until[0] if until else F.lit(True))
        found = scratch.table(searched(dealt, [bytes(r.trie) for r in some.select("trie").collect()]), f"near-{k}")
        near = found if near is None else near.unionByName(found)
    if near is None:
        near = spark.createDataFrame([], "word string, n_near long, form string, form_n long")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    real = -F.col("best.less") >= ratio * F.col("n")
    held = words.join(best, "word", "left").select("word", F.when(real, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(real, -F.col("best.less")).alias("form_n"))
    held = scratch.table(held, "forms")
    roots = held.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(64):  # counts double along a path, so 64 steps are more than any has, and each round doubles them
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = scratch.table(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), f"roots-{k}")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.select("word", "root")
    return held.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
