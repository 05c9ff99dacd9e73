"""Document fingerprints by randomised edit embedding.

A walk reads a text from its first character: at step j it stands on a character c and moves on if a random bit of (j, c)
is set, else it stays. All texts share the random bits, so texts within a few edits fall into step again after each of
them, and their walks differ in few places: edit distance becomes Hamming distance. A fingerprint keeps the walk at fixed
sampled steps, SAMPLES to each doubling of the step number, four bits a step (0: past the end), as hexadecimal digits.
The likeness of two fingerprints is the share of equal samples, each weighted by the steps that it stands for.

Near pairs: bands of sampled bits bring likely pairs together; each is keyed by a doubling of the length, and a text has
those of its own and of the one below, so near texts on two sides of a doubling meet. The least text of a band is its
hub. A hub's members are verified against it by the likeness of whole fingerprints, and groups that still hold several
components are searched breadth-first, so that no link between members of a group is lost and a member sends one pair.

Defined cases: a null or empty text has the empty fingerprint, alike to the empty one (1.0) and to no other (0.0);
equal texts have equal fingerprints; a single document is its own next one; rows with equal or null doc_id follow each
other in the order of their texts' digests, null first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_blocks, mix64, raw_text, released, stream64, texts
from .components import connected, spanning

SAMPLES, BUCKET_BYTES, MOST_BUCKETS, BLOCK_CHARS = 48, 8 << 20, 20_000, 3 << 20
_plans: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def plan(octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(sampled steps in order, weight of each) of the walk's first 2^octaves steps."""
    if octaves not in _plans:
        steps, weights = [np.array([0])], [np.array([1.0])]
        for o in range(octaves):
            width = 1 << o
            some = width + (np.arange(width) if width <= SAMPLES else (np.arange(SAMPLES) * width + (stream64(SAMPLES, 100 + o) % np.uint64(width)).astype(np.int64)) // SAMPLES)
            steps.append(np.unique(some))
            weights.append(np.full(len(steps[-1]), width / len(steps[-1])))
        _plans[octaves] = np.concatenate(steps).astype(np.int64), np.concatenate(weights)
    return _plans[octaves]


def char_hash(points: np.ndarray) -> np.ndarray:
    """32 bits of each code point, never 0; the end of a text is 0."""
    return (mix64(points.astype(np.uint64) + np.uint64(0x51ED)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def walks(batch: list[str]) -> list[str]:
    """The fingerprint of each text, all walks taking each step together."""
    n = len(batch)
    lengths = np.fromiter(map(len, batch), np.int64, n)
    if not n or not lengths.any():
        return [""] * n
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    points = np.frombuffer("\0".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.append(char_hash(points), np.uint32(0))
    chars[start + lengths] = 0
    octaves = int(3 * lengths.max()).bit_length() + 1
    steps, _ = plan(octaves)
    out = np.zeros((n, len(steps)), np.uint8)
    live = np.argsort(-lengths, kind="stable")
    live = live[lengths[live] > 0]
    spot = start[live]
    slot, j = 0, 0
    while len(live):
        turns = stream64(256, 1000 + (j >> 8)).astype(np.uint32) | np.uint32(1)
        for t in range(256):
            c = chars[spot]
            if j == steps[slot]:
                out[live, slot] = np.where(c != 0, (c >> np.uint32(20)) % np.uint32(15) + np.uint32(1), np.uint32(0))
                slot += 1
                if slot == len(steps):
                    return _hex(out)
            c *= turns[t]
            c >>= np.uint32(31)
            spot += c
            j += 1
        going = chars[spot] != 0
        if not going.all():
            live, spot = live[going], spot[going]
    return _hex(out)


def _hex(samples: np.ndarray) -> list[str]:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[samples]
    return [bytes(row).rstrip(b"0").decode() for row in digits]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted share of equal samples, 0 to 1, of each pair of fingerprints."""
    width = max([1, *map(len, a), *map(len, b)])
    octaves = 1
    while len(plan(octaves)[0]) < width:
        octaves += 1
    weights = plan(octaves)[1][:width]
    x, y = (np.frombuffer("".join(s.ljust(width, "0") for s in side).encode(), np.uint8).reshape(-1, width) for side in (a, b))
    some = (x != 48) | (y != 48)
    total = some @ weights
    same = (some & (x == y)) @ weights
    return np.where(total > 0, same / np.maximum(total, 1e-9), 1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each text."""

    def run(batches):
        for batch in batches:
            _, offsets = raw_text(batch.column(1))
            out = [f for low, high in doc_blocks(offsets, BLOCK_CHARS) for f in walks(texts(batch.column(1).slice(low, high - low)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Texts dealt into ranges of doc_id, each followed by a copy of the first row of the next range (the last by the first of all): a row's next row is always beside it."""
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"))
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MOST_BUCKETS, max(1, total // BUCKET_BYTES)))
    cuts = held.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    splits = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, at.to_numpy(), "right").astype(np.int32))

    # At most MOST_BUCKETS rows.
    first = sorted((r.bucket, r.at) for r in held.select("at", bucket("at").alias("bucket")).groupBy("bucket").agg(F.min("at").alias("at")).collect())
    follows = {at: first[i - 1][0] for i, (_, at) in enumerate(first)}
    leads, before = np.array(sorted(follows), np.int64), np.array([follows[k] for k in sorted(follows)], np.int32)

    @F.pandas_udf("array<int>")
    def places(at: pd.Series) -> pd.Series:
        values = at.to_numpy()
        own = np.searchsorted(splits, values, "right")
        if not len(leads):
            return pd.Series([[int(o)] for o in own])
        spot = np.minimum(np.searchsorted(leads, values), len(leads) - 1)
        return pd.Series([[int(o), int(before[s])] if leads[s] == v else [int(o)] for o, s, v in zip(own, spot, values, strict=True)])

    dealt = held.withColumn("places", places("at")).select("doc_id", "text", "at", F.posexplode("places").alias("copy", "bucket"))
    order = F.sha2("text", 256)
    return dealt.withColumn("digest", order).repartitionById(len(splits) + 1, "bucket").sortWithinPartitions("bucket", "copy", "at", "digest").select("doc_id", "text", "copy", "bucket")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last quarter replaced by the start of the next document), and the likeness to both neighbours."""

    def results(rows: list[tuple], names: list[str], kind: pa.DataType):
        own, after = [r[1] for r in rows], [r[2] for r in rows]
        edited = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for t, a in zip(own, after, strict=True)]
        # A row's next text is the following row's own text: each is walked once.
        walked = dict(zip(seen := list(dict.fromkeys([*own, *after])), walks(seen), strict=True))
        of_edited = walks(edited)
        mine = [walked[t] for t in own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], kind), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()), pa.array(mine, pa.string()), pa.array(of_edited, pa.string()),
                pa.array(likeness(mine, of_edited)), pa.array(likeness(mine, [walked[a] for a in after])),
            ],
            names,
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        kind = pa.int64()
        # One bucket's rows come in order, its copies last; of the copies the first is the last row's next one.
        last, place, ended, rows, held = None, None, False, [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for low, high in doc_blocks(raw_text(batch.column(1))[1], 1 << 20):
                part = batch.slice(low, high - low)
                for doc_id, text, copy, bucket in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bucket != place:
                        last, place, ended = None, bucket, False
                    if ended:
                        continue
                    if last is not None:
                        rows.append((*last, text))
                        held += len(last[1])
                    last, ended = (doc_id, text), copy > 0
                    if held >= BLOCK_CHARS:
                        yield results(rows, names, kind)
                        rows, held = [], 0
        if rows:
            yield results(rows, names, kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs).mapInArrow(released(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def prints(rows: list[str]) -> np.ndarray:
    """Fingerprints as rows of samples, all as wide as the longest; past an end 0."""
    width = max(map(len, rows), default=0)
    return np.frombuffer("".join(r.ljust(width, "0") for r in rows).encode(), np.uint8).reshape(len(rows), width) - np.uint8(48)


def alike(rows: list[str], at_least: float):
    """Which members of a group are as alike as that."""
    samples = prints(rows)
    octaves = 1
    while len(plan(octaves)[0]) < samples.shape[1]:
        octaves += 1
    weights = plan(octaves)[1][: samples.shape[1]]
    some = samples != 0

    def near(take: np.ndarray, rest: np.ndarray) -> np.ndarray:
        total, same = np.zeros((len(take), len(rest))), np.zeros((len(take), len(rest)))
        for k in range(samples.shape[1]):
            a, b = samples[take, k][:, None], samples[rest, k][None]
            either = some[take, k][:, None] | some[rest, k][None]
            total += either * weights[k]
            same += (either & (a == b)) * weights[k]
        return same >= at_least * np.maximum(total, 1e-9)

    return near


def near_pairs(docs: DataFrame, at_least: float = 0.8, bands: int = 24, width: int = 4, tile: int = 1 << 12) -> DataFrame:
    """(doc_id, hub, likeness): pairs of near texts that connect all that share a band and are linked, and equal texts with their first.

    Only texts that differ are banded, each group of equal ones by its first document. Groups of over `tile` members are
    dealt out by pairs of tiles.
    """
    scratch = Scratch(docs.sparkSession, "near")
    found = scratch.table(fingerprints(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "prints")
    classes = scratch.table(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, digits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (len(digits) - 1) // SAMPLES
                for octave in range(max(0, own - 1), own + 1) if digits else ():
                    for b in range(bands):
                        spots = (stream64(width, 5000 + b) % np.uint64(max(1, min(len(digits), max(1, octave) * SAMPLES)))).astype(int)
                        keys.append(f"{octave}:{b}:" + "".join(digits[s] for s in spots))
                        ids.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["rep", "band"])

    banded = scratch.table(classes.select("first", "fingerprint").mapInArrow(released(run), "rep long, band string").distinct(), "bands")
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub")
    near = scratch.table(banded.join(hubs, "band").where("rep <> hub").select("hub", "rep").distinct(), "members")
    held = classes.select(F.col("first").alias("rep"), "fingerprint")

    @F.pandas_udf("double")
    def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(likeness(a.tolist(), b.tolist()))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.toDF("a", "mine"), "a").join(held.toDF("b", "theirs"), "b")
        return both.select("a", "b", likeness_of("mine", "theirs").alias("likeness")).where(F.col("likeness") >= at_least)

    links = scratch.table(scored(near.toDF("a", "b")), "links-1")
    component = scratch.table(connected(links.select("a", "b"), scratch, "component"), "labels")
    groups = near.unionByName(near.select("hub", F.col("hub").alias("rep")).distinct())
    rows = groups.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = rows.groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members"))
    mixed = scratch.table(mixed.where("least <> most and members > 2").select("hub", F.ceil(F.col("members") / tile).cast("int").alias("tiles")), "mixed")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    lots = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, own) * F.col("tiles") + F.greatest(t, own))
    dealt = rows.join(mixed, "hub").withColumn("lot", F.explode(F.array_distinct(lots))).join(held, "rep")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        reps = part["rep"].to_numpy()
        pairs = spanning(part["component"].to_numpy(), alike(part["fingerprint"].tolist(), at_least), -1, 1 << 16)
        pairs = np.sort(reps[np.concatenate(pairs)], axis=1) if pairs else np.zeros((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    more = dealt.groupBy("hub", "lot").applyInPandas(search, "a long, b long").distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")
    more = scratch.table(scored(more), "links-2")
    equal = found.join(classes, "fingerprint").where("doc_id <> first").select("doc_id", F.col("first").alias("hub"), F.lit(1.0).alias("likeness"))
    return links.unionByName(more).select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "likeness").unionByName(equal)
