"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets of similarity p/q or more differ in few elements, at most H for a band of sizes. A hash cuts the universe of
shingles into segments, their number set by the band, and a linked pair agrees in enough segments:
* exact: of H + 1 + E segments at least E + 1 are equal. Each set keeps the H + 1 whose contents are costliest to share
  (most elements, then hash). The choice looks at contents alone, so the best of a pair's equal segments is kept by both.
  Empty segments and those of a few elements, which many sets share by chance, fall out of the E spare ones.
* one deletion: of H // 2 + 1 segments at least one differs in one element at most, so the signatures of a segment and of
  it less each element meet. Bands of small sets, whose exact segments would be short, take this; `allocate` weighs both.
Empty segments have no signatures. Sets so concentrated that a pair's equal segments could all be empty cut the universe
again by another hash, and again, until they are not; the last cut's empty segments have signatures.

Equal sets are one class, represented by their least doc_id. Sets that share a signature are candidates: the least of them
is its hub, and a hub's group holds all sets that share a signature of which it is the least, so any two candidates are
together in a group, and a group is one row a member however many signatures its members share. There are three rounds.
1. Each group's members meet its hub; links are verified on whole texts, and components are formed.
2. Each group that still holds several components is searched breadth-first with a parity sketch, a lower bound of the
   difference that never drops a link and is as wide as the sets are large. A member reached once is not compared again,
   so a group sends one pair a member at most. Where all of them prove to be links, the group has no other link between
   its components.
3. Groups of which a pair proved to be none are searched once more, with whole sets: what is sent now is a link.
So the pairs that are sent follow the groups' sizes, not their squares, and no link between components is lost. Groups of
over TILE members, or of large sets, that still hold several components are dealt out by pairs of tiles, each a task's
bounded share: there a member goes to as many lots as its group has tiles, so rows grow with the square of such a group,
over TILE.

Elements are 64-bit hashes of shingles. Defined cases: null and empty texts, and texts without words, have no shingles
and link with nothing; fewer words than k make one shingle; each row is judged by its own text, rows that repeat a doc_id
count as one node of the graph; rows with a null doc_id link as any other, but the null counts as the largest id, so a
component of such rows alone has a null component_id.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, doc_blocks, likely, mix64, raw_text, released, shingles, without
from .components import connected, spanning

SPARE = 0.2  # E as a share of H + 1
CHANCE = 1e5  # other sets of a band that a short segment is weighed against
BITS = {4: 4}  # bits by which one element tells sets apart, by the words of a shingle; longer shingles are rarer
MOST_BITS = 8
BLOCK = 1 << 20  # bytes of text whose sets a worker holds at once
HELD = 1 << 20  # sets of one signature that a worker holds at once
SKETCH, DENSE = 512, 4  # parity bits of a sketch, and at least so many an element, up to the next power of two
TILE = 1 << 13  # members of a group that meet in one task
MEET = 1 << 17  # pairs compared at once
TILE_ELEMENTS = 1 << 20  # of the whole sets of a tile
WIDER = 8  # bits an element of the third round's sketches
CUTS = 10  # of the universe; few sets need a second, and those that reach the last send empty segments, too
NO_ID = 1 << 62  # keys from here on stand for null ids


class Bands:
    """Size bands for a threshold p/q: a set links with sets of its own band and of those beside it."""

    def __init__(self, p: int, q: int, bits: int = 4, most: int = 1 << 26):
        self.p, self.q, self.bits = p, q, bits
        low, edge = [1], Fraction(1)
        while low[-1] < most:
            edge *= Fraction(q, p)
            low.append(-(-edge.numerator // edge.denominator))
        self.low = np.array(low, np.int64)
        self.high = np.append(self.low[1:] - 1, 2 * self.low[-1])
        self.errors = self.high * (q - p) // p
        self.deletion, self.segments, self.kept = (np.zeros(len(low), t) for t in (bool, np.int64, np.int64))
        for b in range(len(low)):
            self.deletion[b], self.segments[b], self.kept[b] = self.allocate(int(self.high[b]), int(self.errors[b]))

    def allocate(self, size: int, errors: int) -> tuple[bool, int, int]:
        """(one deletion?, segments, segments kept) at the least cost: signatures, each with those it meets by chance."""
        exact, paired = errors + 1, errors // 2 + 1
        spare = int(np.ceil(SPARE * exact))

        def meets(elements: float) -> float:
            return 1 + CHANCE * 2.0 ** (-self.bits * elements)

        whole, less = exact * meets(size / (exact + spare)), (size + paired) * meets(max(size / paired - 1, 0))
        return (True, paired, paired) if less < whole else (False, exact + spare, exact)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


class Sets:
    """The shingle sets of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        self.hash, self.doc = shingles(Words(data, offsets), k)
        self.size = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over the elements: equal for equal sets."""
        out = np.zeros((2, len(self.size)), U64)
        some = self.size > 0
        if some.any():
            for i, salt in enumerate((0x1F0A, 0x77C3)):
                out[i, some] = np.add.reduceat(mix64(self.hash + U64(salt)), self.first[some])
        return out[0].view(np.int64), out[1].view(np.int64)

    def sketches(self) -> list[bytes]:
        """Parity bits of the elements: they differ in no more places than the sets do. A sketch folded in half is the narrower one."""
        wide = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(self.size * DENSE, 1))).astype(np.int64))
        base = np.concatenate(([0], np.cumsum(wide)))
        spot = (mix64(self.hash ^ U64(0x5CE7)) & (wide[self.doc] - 1).astype(U64)).astype(np.int64) + base[self.doc]
        held = np.packbits((np.bincount(spot, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
        return [held[x:y] for x, y in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]

    def signatures(self, bands: Bands, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, text) of the texts in `use`, for their own band and the next lower one."""
        keys, owners = [], []
        for lower in (0, 1):
            band = bands.of(np.maximum(self.size, 1)) - lower
            fits = use & (self.size > 0) & (band >= 0) & (bands.errors[np.maximum(band, 0)] > 0)
            for deletion in (False, True):
                chosen = fits & (bands.deletion[np.maximum(band, 0)] == deletion)
                if chosen.any():
                    k, o = self._band(bands, band, chosen, deletion)
                    keys.append(k)
                    owners.append(o)
        return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))

    def _band(self, bands: Bands, band: np.ndarray, chosen: np.ndarray, deletion: bool) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of one cut of the universe, and of further cuts for the sets whose equal segments may all be empty: both of a pair go on."""
        keys, owners = [], []
        for cut in range(CUTS):
            k, o, again = self._cut(bands, band, chosen, deletion, cut, cut == CUTS - 1)
            keys.append(k)
            owners.append(o)
            chosen = again
            if not chosen.any():
                break
        return np.concatenate(keys), np.concatenate(owners)

    def _cut(self, bands: Bands, band: np.ndarray, chosen: np.ndarray, deletion: bool, cut: int, empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, text, texts that need another cut); empty: signatures of empty segments, too."""
        number = np.where(chosen, bands.segments[np.maximum(band, 0)], 0)
        base = np.concatenate(([0], np.cumsum(number)[:-1]))
        inside = chosen[self.doc]
        h, doc = self.hash[inside], self.doc[inside]
        cell = base[doc] + (mix64(h ^ U64(0x9A11 + (cut << 32))) % number[doc].astype(U64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, part = cell[order], mix64(h[order] + U64(0x33))
        total = int(number.sum())
        count = np.bincount(cell, minlength=total)
        sums = np.zeros(total, U64)
        full = np.flatnonzero(count)
        if len(full):
            sums[full] = np.add.reduceat(part, np.searchsorted(cell, full))
        owner = np.repeat(np.arange(len(self.size)), number)
        salt = (np.arange(total) - base[owner]).astype(U64) * U64(0x2545F4914F6CDD1D) + band[owner].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(cut * 0x0D1B54A32D192ED0)
        # A pair is missed only if each of its equal segments (or of those one element apart) is empty in one of its sets. Then
        # both sets lie in the segments that may differ: `kept` - 1 of them, or all but one with two elements or more.
        kept = bands.kept[np.maximum(band, 0)]
        again = chosen & (kept > 1) & (np.bincount(owner[count > int(deletion)], minlength=len(self.size)) < kept)
        if deletion:
            keys = np.concatenate((mix64(sums ^ salt), mix64((sums[cell] - part) ^ salt[cell])))
            owners = np.concatenate((owner, owner[cell]))
            real = np.concatenate((count > 0, count[cell] > 1)) | (number[owners] == 1) | empty
            return keys[real], owners[real], again
        order = np.lexsort((sums, -count, owner))
        place = np.arange(total) - base[owner[order]]
        keep = order[place < kept[owner[order]]]
        keep = keep[(count[keep] > 0) | empty]
        return mix64(sums[keep] ^ salt[keep]), owner[keep], again


def _blocks(column: pa.Array, k: int):
    data, offsets = raw_text(column)
    for low, high in doc_blocks(offsets, BLOCK):
        yield low, high, Sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): size, digests and parity sketch of each text's set."""

    def run(batches):
        for batch in batches:
            for low, high, sets in _blocks(batch.column(1), k):
                d1, d2 = sets.digests()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets.size), pa.array(d1), pa.array(d2), pa.array(sets.sketches(), pa.binary())], ["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n long, d1 long, d2 long, sketch binary")


def signed(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(sig, doc_id) of every set."""

    def run(batches):
        bands = Bands(p, q, BITS.get(k, MOST_BITS if k > 4 else k))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, sets in _blocks(batch.column(1), k):
                keys, owners = sets.signatures(bands, np.ones(high - low, bool))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[low + owners], pa.int64())], ["sig", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "sig long, doc_id long")


def hubs_of(batches, most: int = HELD):
    """(sig, hub, rep) from batches (sig, rep) sorted by signature: each signature's least set as the hub of the others, without the signature; rows of one that over `most` share keep it, without a hub."""

    def out(rep, sig=None, hub=None):
        blank = pa.nulls(len(rep), pa.int64())
        return pa.RecordBatch.from_arrays([blank if sig is None else pa.array(sig), blank if hub is None else pa.array(hub), pa.array(rep)], ["sig", "hub", "rep"])

    def solved(rep, starts):
        size = np.diff(np.append(starts, len(rep)))
        hub = np.repeat(np.minimum.reduceat(rep, starts), size)
        other = rep != hub
        if other.any():
            yield out(rep[other], hub=hub[other])

    waiting, lead, many = [], None, False  # the sets of the last signature, which may go on; whether they are over `most`
    for batch in batches:
        sig, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(sig):
            continue
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        if sig[0] == lead:
            waiting.append(rep[: starts[1]] if len(starts) > 1 else rep)
            starts = starts[1:]
        if many or sum(map(len, waiting)) > most:
            held = np.concatenate([*waiting, rep[:0]])
            if len(held):
                yield out(held, sig=np.full(len(held), lead))
            waiting, many = [], True
        if not len(starts):
            continue
        n = sum(map(len, waiting))
        ended = np.concatenate(([0] * bool(n), starts[:-1] - starts[0] + n)).astype(np.int64)
        if len(ended):
            yield from solved(np.concatenate([*waiting, rep[starts[0] : starts[-1]]]), ended)
        waiting, lead, many = [rep[starts[-1] :]], sig[-1], False
    if waiting:
        yield from solved(np.concatenate(waiting), np.zeros(1, np.int64))


def grouped(rows: DataFrame, scratch: Scratch, most: int = HELD) -> DataFrame:
    """(hub, rep) of the sets that share a signature with a lesser one, their hub; rows: (sig, doc_id) of every set."""

    def run(batches):
        yield from hubs_of(batches, most)

    met = rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(released(run), "sig long, hub long, rep long").distinct()
    met = scratch.table(met, "met")
    near, many = met.where("hub is not null").select("hub", "rep"), met.where("hub is null").select("sig", "rep")
    if not many.limit(1).count():
        return near
    hubs = many.groupBy("sig").agg(F.min("rep").alias("hub"))
    return scratch.table(near.unionByName(many.join(hubs, "sig").where("rep <> hub").select("hub", "rep")).distinct(), "near")


def verified(pairs: DataFrame, docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The (a, b) pairs whose texts' sets have a similarity of p/q or more."""

    def run(batches):
        for batch in batches:
            left, right = (raw_text(batch.column(i))[1] for i in (2, 3))
            for low, high in doc_blocks(left + right, BLOCK):
                sides = []
                for i in (2, 3):
                    data, offsets = raw_text(batch.column(i).slice(low, high - low))
                    sides.append(Sets(data, offsets, k))
                doc = np.concatenate([s.doc for s in sides])
                h = np.concatenate([s.hash for s in sides])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                both = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=high - low)
                union = sides[0].size + sides[1].size - both
                linked = (q * both >= p * union) & (union > 0)
                yield batch.slice(low, high - low).select(["a", "b"]).filter(pa.array(linked))

    held = likely(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    one = pairs.join(held.toDF("a", "left"), "a")
    two = one.join(held.toDF("b", "right"), "b")
    return two.select("a", "b", "left", "right").mapInArrow(released(run), "a long, b long")


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of words, all as wide as the narrowest."""
    least = min(map(len, sketches))
    if max(map(len, sketches)) > least:
        out = []
        for s in sketches:
            row = np.frombuffer(s, np.uint64)
            out.append(np.bitwise_xor.reduce(row.reshape(-1, least // 8), axis=0) if len(s) > least else row)
        return np.stack(out)
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def may_link(p: int, q: int):
    """The sketch's bound as a column over (a_n, b_n, a_sketch, b_sketch)."""
    @F.pandas_udf("boolean")
    def check(a_n: pd.Series, b_n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a_n), bool)
        least = np.minimum(a.str.len().to_numpy(), b.str.len().to_numpy())
        m, n, left, right = a_n.to_numpy(), b_n.to_numpy(), a.to_numpy(), b.to_numpy()
        for width in np.unique(least).tolist():
            some = np.flatnonzero(least == width)
            for at in range(0, len(some), max(1, MEET * 64 // width)):
                part = some[at : at + max(1, MEET * 64 // width)]
                blank = [bytes(width)]  # its width is what the others are folded to
                x, y = folded([*left[part], *blank])[:-1], folded([*right[part], *blank])[:-1]
                out[part] = possible(m[part], n[part], np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), p, q)
        return pd.Series(out)

    return check


def possible(m: np.ndarray, n: np.ndarray, differ: np.ndarray, p: int, q: int) -> np.ndarray:
    return (q * np.minimum(m, n) >= p * np.maximum(m, n)) & (differ * (p + q) <= (m + n) * (q - p))


def may_meet(n: np.ndarray, sketch: np.ndarray, p: int, q: int):
    """The sketch's bound between members of a group."""

    def near(take: np.ndarray, rest: np.ndarray) -> np.ndarray:
        differ = np.zeros((len(take), len(rest)), np.int64)
        for w in range(sketch.shape[1]):
            differ += np.bitwise_count(sketch[take, w][:, None] ^ sketch[rest, w][None])
        return possible(n[take][:, None], n[rest][None], differ, p, q)

    return near


class Whole:
    """A group's whole sets: their sketches, and which pairs of them are linked."""

    def __init__(self, elements: list[bytes], p: int, q: int):
        self.p, self.q = p, q
        self.sets = [np.frombuffer(e, np.uint64) for e in elements]
        self.size = np.array([len(x) for x in self.sets], np.int64)

    def sketches(self) -> np.ndarray:
        words = max(8, 1 << int(np.ceil(np.log2(self.size.max() * WIDER / 64))))
        out = np.zeros(len(self.sets) * words, np.uint64)
        for i, x in enumerate(self.sets):
            spot = mix64(x ^ U64(0x5CE7)) & U64(words * 64 - 1)
            np.bitwise_xor.at(out, (spot >> U64(6)).astype(np.int64) + i * words, U64(1) << (spot & U64(63)))
        return out.reshape(len(self.sets), words)

    def linked(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), bool)
        total = np.cumsum(self.size[pairs].sum(axis=1))
        cuts = np.searchsorted(total, np.arange(0, total[-1], 1 << 20)).tolist() + [len(pairs)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low < high:
                some = pairs[low:high]
                h = np.concatenate([self.sets[i] for i in some.ravel().tolist()])
                which = np.repeat(np.arange(high - low), self.size[some].sum(axis=1))
                order = np.lexsort((h, which))
                h, which = h[order], which[order]
                both = np.bincount(which[1:][(h[1:] == h[:-1]) & (which[1:] == which[:-1])], minlength=high - low)
                union = self.size[some].sum(axis=1) - both
                out[low:high] = self.q * both >= self.p * union
        return out


def forests(rows: DataFrame, p: int, q: int, whole: bool) -> DataFrame:
    """(hub, a, b) pairs that reach all candidates of each hub's group or tile pair, from rows (hub, lot, rep,
    component, n, held) sorted by (hub, lot); held: sketches, or whole sets, whose pairs are links. Pairs with the hub of a
    whole group were tried before."""
    names = ("hub", "lot", "rep", "component", "n")

    def group(part: dict) -> np.ndarray | None:
        comp = part["component"]
        if (comp == comp[0]).all():
            return None
        held, hub = part["held"].tolist(), int(part["rep"].argmin()) if part["lot"][0] < 0 else -1
        if whole:
            sets = Whole(held, p, q)
            found = spanning(comp, may_meet(part["n"], sets.sketches(), p, q), hub, MEET, sets.linked)
        else:
            found = spanning(comp, may_meet(part["n"], folded(held), p, q), hub, MEET)
        if not found:
            return None
        pairs = np.sort(part["rep"][np.concatenate(found)], axis=1)
        return np.column_stack((np.full(len(pairs), part["hub"][0]), pairs))

    def run(batches):
        def solved(parts):
            found = [x for part in parts if (x := group(part)) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(np.concatenate(found).T)], ["hub", "a", "b"])

        waiting, key = [], None  # the parts of the last group, which may go on
        for batch in batches:
            if not len(batch):
                continue
            part = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(names)}
            part["held"] = np.array(batch.column(5).to_pylist(), object)
            starts = np.flatnonzero(np.concatenate(([True], (part["hub"][1:] != part["hub"][:-1]) | (part["lot"][1:] != part["lot"][:-1]))))
            cuts = [{name: v[a:b] for name, v in part.items()} for a, b in zip(starts, np.append(starts[1:], len(batch)), strict=True)]
            if key == (cuts[0]["hub"][0], cuts[0]["lot"][0]):
                waiting.append(cuts.pop(0))
            if cuts:
                if waiting:
                    yield from solved([{name: np.concatenate([w[name] for w in waiting]) for name in part}])
                yield from solved(cuts[:-1])
                waiting, key = [cuts[-1]], (cuts[-1]["hub"][0], cuts[-1]["lot"][0])
        if waiting:
            yield from solved([{name: np.concatenate([w[name] for w in waiting]) for name in waiting[0]}])

    return rows.select(*names, "held").mapInArrow(released(run), "hub long, a long, b long")


def elements(docs: DataFrame, k: int) -> DataFrame:
    """(rep, held): each text's whole set."""

    def run(batches):
        for batch in batches:
            for low, high, sets in _blocks(batch.column(1), k):
                ends = np.append(sets.first[1:], len(sets.hash))
                held = [sets.hash[a:b].tobytes() for a, b in zip(sets.first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(held, pa.binary())], ["rep", "held"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "rep long, held binary")


def keyed(docs: DataFrame) -> Column:
    """The key of a row: its doc_id, or for a null one a number from its text beyond all ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(NO_ID - 1) + F.lit(NO_ID))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with their lot: -1, or in a group of several tiles each pair of tiles that holds the row's own."""
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, own) * F.col("tiles") + F.greatest(t, own))
    return rows.withColumn("lot", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(-1))).otherwise(F.array_distinct(pairs)))).drop("tiles")


def labelled(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; docs: (doc_id, text) with keys for ids."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    sums = scratch.table(summaries(docs, k), "sums")
    classes = scratch.table(sums.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that a hot set's join may be split
    members = sums.join(classes, ["d1", "d2"]).select("doc_id", "rep", "n", "sketch")
    members = scratch.table(members.unionByName(sums.where("n = 0").select("doc_id", F.col("doc_id").alias("rep"), "n", "sketch")), "members")
    reps = members.where("doc_id = rep and n > 0").select("rep", "n", F.col("sketch").alias("held")).distinct()

    # Of equal sets the representative's text alone is signed.
    copies = members.where("n > 0").groupBy("doc_id").agg(F.max(F.expr("int(doc_id = rep)")).alias("own")).where("own = 0").select("doc_id")
    copies = scratch.table(copies, "copies")
    near = grouped(signed(without(docs, copies, "doc_id"), k, p, q), scratch)
    near = near.unionByName(near.select("hub", F.col("hub").alias("rep")).distinct())
    reps = scratch.table(likely(reps, near.select("rep"), "rep"), "reps")

    def components(links: DataFrame, turn: int) -> DataFrame:
        return scratch.table(connected(links, scratch, f"component-{turn}"), f"labels-{turn}")

    def searched(groups: DataFrame, component: DataFrame, held: DataFrame, whole: bool, name: str) -> DataFrame:
        """The forests of the groups of several components; both of two members met as hub and member."""
        rows = groups.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", F.coalesce("component", "rep").alias("component"))
        size = F.ceil(F.count(F.lit(1)) / TILE)
        if whole:
            rows = rows.join(reps.select("rep", "n"), "rep")
            size = F.greatest(size, F.ceil(F.sum("n") / TILE_ELEMENTS))
        mixed = rows.groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members"), size.cast("int").alias("tiles"))
        mixed = scratch.table(mixed.where("least <> most and members > 2").select("hub", "tiles"), f"mixed-{name}")  # written, so that a hot group's join may be split
        rows = dealt(rows.select("hub", "rep", "component").join(mixed, "hub")).join(held, "rep")
        return scratch.table(forests(rows.repartition("hub", "lot").sortWithinPartitions("hub", "lot", "rep"), p, q, whole), name)

    check = may_link(p, q)
    pairs = near.where("rep <> hub").toDF("a", "b").join(reps.toDF("a", "a_n", "a_sketch"), "a").join(reps.toDF("b", "b_n", "b_sketch"), "b")
    tried = scratch.table(pairs.where(check("a_n", "b_n", "a_sketch", "b_sketch")).select("a", "b").distinct(), "pairs-1")
    links = scratch.table(verified(tried, docs, k, p, q), "links-1")
    component = components(links, 1)

    found = searched(near, component, reps, False, "forests-2")
    fresh = scratch.table(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs-2")
    if fresh.limit(1).count():
        links = links.unionByName(scratch.table(verified(fresh, docs, k, p, q), "links-2"))
        component = components(links, 2)
    doubtful = scratch.table(found.join(links, ["a", "b"], "left_anti").select("hub").distinct(), "doubtful")
    if doubtful.limit(1).count():
        rest = scratch.table(near.join(doubtful, "hub"), "groups-3")
        nodes = rest.select(F.col("rep").alias("doc_id")).distinct()
        texts = likely(docs.select("doc_id", "text"), nodes, "doc_id").join(nodes, "doc_id").select("doc_id", "text")
        held = elements(texts, k).join(reps.select("rep", "n"), "rep")
        more = searched(rest, component, held, True, "forests-3")
        component = components(links.unionByName(more.select("a", "b").distinct()), 3)
    out = members.select("doc_id", "rep", F.col("n").alias("n_shingles")).join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def join(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every text: sets of k-word shingles, linked at a similarity of p/q or more."""
    out = labelled(docs.select(keyed(docs).alias("doc_id"), "text"), k, p, q)
    return out.select(*(F.when(F.col(c) < NO_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns))


def one_of_each(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows that stay when one document of each group does, all columns kept; of rows with one doc_id and group, the least as a row."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    held = docs.withColumn(key, keyed(docs))
    found = Scratch(docs.sparkSession, "one").table(labelled(held.select(F.col(key).alias("doc_id"), "text"), k, p, q), "labels")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = without(held, gone, key)
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias(key))
    if twice.limit(1).count():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        order = F.struct(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
        again = kept.join(twice, key, "left_semi").groupBy(key).agg(F.min_by(whole, order).alias("row")).select("row.*")
        kept = kept.join(twice, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(again)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
