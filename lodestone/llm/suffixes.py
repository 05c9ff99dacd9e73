"""External recursive induced suffix sorting with common-prefix values.

Suffixes are L (larger than their successor) or S; the leftmost S ones (LMS) are sorted first, all others follow by
induction: a suffix taken in order sends its predecessor to the queue of the predecessor's first letter. The order in
which a queue is filled is the order of its suffixes, so first-in first-out queues, one a letter or range of letters, are
a priority queue; on bytes each entry carries the common prefix with the entry before it, which is one more than the
least common prefix met since that one was sent.

LMS suffixes are sorted by naming the pieces between them, by the same induction, and by sorting the shorter text of
names recursively. Names are many, so a queue there holds a range of names; when its turn comes its entries are ordered,
and taken in the largest lots that send nothing before their own end. Each level's letters stand for two of the level
above at least, so a level need be right to half as many letters, and the recursion ends where names are unique or one
name reaches far enough.

Queues beyond a number of bytes live in a temporary file of the task and are read back in chunks; arrays beyond it are
mapped files of the same kind, so what a sort keeps in memory doesn't follow its text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18  # entries of a queue taken at once
DIRECT = 7  # names compared at the last level
RANGE, LOOK = 1 << 12, 1 << 11  # entries of a range of names, and of those that are weighed for a lot
NEVER = np.int32(2**31 - 1)
ENTRY = np.dtype([("at", np.int32), ("lcp", np.uint8)])


class Spill:
    """Temporary files of a sort: its queues' blocks beyond `memory` bytes, and its arrays above that size."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.blocks = memory, 0, None, 0

    def array(self, n: int, kind: type, fill: int | None = None) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.memory:
            return np.empty(n, kind) if fill is None else np.full(n, fill, kind)
        with tempfile.TemporaryFile(prefix="array-") as file:  # lives as long as its mapping
            file.truncate(size)
            out = np.memmap(file, kind, "r+", shape=(n,))
        if fill:
            out[:] = fill
        return out

    def write(self, block: np.ndarray) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queues-")
        at = self.file.seek(0, 2)
        self.file.write(block.tobytes())
        self.blocks += 1
        return at, len(block)

    def read(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """Entries in the order of sending: positions, and common prefixes with the entry before."""

    def __init__(self, spill: Spill, kind: np.dtype = ENTRY):
        self.spill, self.kind, self.blocks, self.size = spill, kind, [], 0

    def put(self, block: np.ndarray) -> None:
        self.size += len(block)
        if self.spill.held + block.nbytes > self.spill.memory:
            self.blocks.append(self.spill.write(block))
        else:
            self.spill.held += block.nbytes
            self.blocks.append(block)

    def send(self, at: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(at), ENTRY)
        block["at"], block["lcp"] = at, lcp
        self.put(block)

    def taken(self) -> Iterator[np.ndarray]:
        """The entries sent so far, in chunks; those sent meanwhile wait for the next call."""
        blocks, self.blocks, self.size = self.blocks, [], 0
        waiting, n = [], 0
        for block in blocks:
            if isinstance(block, tuple):
                block = self.spill.read(*block, self.kind)
            else:
                self.spill.held -= block.nbytes
            waiting.append(block)
            n += len(block)
            if n >= CHUNK:
                yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
                waiting, n = [], 0
        if waiting:
            yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) for each pair, by a table of doubling widths; every range holds a value."""
    out = np.empty(len(low), values.dtype)
    power = np.frexp((high - low).astype(np.float32))[1] - 1
    level = values
    for k in range(int(power.max(initial=-1)) + 1):
        some = np.flatnonzero(power == k)
        if len(some):
            out[some] = np.minimum(level[low[some]], level[high[some] - (1 << k)]) if k else level[low[some]]
        if len(level) > 1 << k:
            level = np.minimum(level[: -(1 << k)], level[1 << k :])
    return out


class Sender:
    """Sends predecessors of a sorted run of suffixes to their queues, with common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, letters: int, cap: int, spill: Spill, prefixes: bool):
        self.text, self.wanted, self.cap, self.prefixes = text, wanted, cap, prefixes
        self.queues = [Queue(spill) for _ in range(letters)]
        self.least = np.zeros(letters, np.uint8)  # least common prefix met since a letter's last entry

    def take(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """The next suffixes in order; lcp: with the suffix taken before."""
        if not len(at):
            return
        spot = np.flatnonzero((at > 0) & self.wanted[at - 1])
        before = at[spot] - 1
        letter = self.text[before]
        order = np.argsort(letter, kind="stable")
        letter, before, spot = letter[order], before[order], spot[order].astype(np.int32)
        first = np.ones(len(spot), bool)
        first[1:] = letter[1:] != letter[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(spot)) if len(starts) else starts
        if not self.prefixes:
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                self.queues[letter[a]].send(before[a:b], 0)
            return
        low = np.zeros(len(spot), np.int32)
        low[1:] = spot[:-1] + 1
        low[first] = 0
        met = least(lcp, low, spot + 1) if len(spot) else lcp[:0]
        met[first] = np.minimum(met[first], self.least[letter[first]])
        np.minimum(self.least, lcp.min(), out=self.least)
        carried = np.minimum(met, self.cap - 1) + np.uint8(1)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            c = int(letter[a])
            self.queues[c].send(before[a:b], carried[a:b])
            tail = lcp[spot[b - 1] + 1 :]
            self.least[c] = tail.min() if len(tail) else self.cap


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to cap."""
    out = np.zeros(len(a), np.uint8)
    live, n = np.arange(len(a)), len(text)
    x, y = a.astype(np.int64), b.astype(np.int64)
    for _ in range(cap):
        same = text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]
        same &= (x < n) & (y < n)
        live, x, y = live[same], x[same] + 1, y[same] + 1
        if not len(live):
            break
        out[live] += 1
    return out


def induce(text: np.ndarray, larger: np.ndarray, seeds: list[np.ndarray], prefixes: list[np.ndarray] | None, letters: int, cap: int, spill: Spill) -> tuple[np.ndarray, np.ndarray | None]:
    """(suffixes in order, common prefix with the one before), from the LMS suffixes of each letter in order.

    Without prefixes of the seeds: the S suffixes' order alone, without common prefixes.
    """
    whole = prefixes is not None
    lower = Sender(text, larger, letters, cap, spill, whole)
    ordered: list[Queue] = []
    ends = np.full(letters, -1, np.int64)  # the last L suffix of each letter
    for c in range(letters):
        kept = Queue(spill)
        fresh = True
        while lower.queues[c].size:
            for part in lower.queues[c].taken():
                at, lcp = np.ascontiguousarray(part["at"]), part["lcp"].copy()
                if fresh:
                    lcp[0], fresh = 0, False
                kept.send(at, lcp)
                lower.take(at, lcp)
                ends[c] = at[-1]
        ordered.append(kept)
        if len(seeds[c]):
            lcp = prefixes[c] if whole else np.zeros(len(seeds[c]), np.uint8)
            lcp[0] = common(text, ends[c : c + 1], seeds[c][:1], cap)[0] if whole and ends[c] >= 0 else 0
            lower.take(seeds[c], lcp)
    upper = Sender(text, ~larger, letters, cap, spill, whole)
    total = sum(q.size for q in ordered) if whole else 0
    down = Queue(spill)  # in falling order; a common prefix there is with the entry before, the next larger suffix
    for c in range(letters - 1, -1, -1):
        last, fresh = -1, True
        while upper.queues[c].size:
            for part in upper.queues[c].taken():
                at, lcp = np.ascontiguousarray(part["at"]), part["lcp"].copy()
                if fresh:
                    lcp[0], fresh = 0, False
                down.send(at, lcp)
                total += len(at)
                upper.take(at, lcp)
                last = at[-1]
        if ordered[c].size:
            back = np.concatenate(list(ordered[c].taken()))
            at = np.ascontiguousarray(back["at"][::-1])
            lcp = np.append(np.uint8(0), back["lcp"][:0:-1])
            if last >= 0 and whole:
                lcp[0] = common(text, np.array([last]), at[:1], cap)[0]
            upper.take(at, lcp)
            if whole:
                down.send(at, lcp)
    if not whole:
        total = down.size
    order, found = spill.array(total, np.int32), spill.array(total if whole else 0, np.uint8)
    low, carry = total, 0
    for part in down.taken():
        order[low - len(part) : low] = part["at"][::-1]
        if whole:  # what falls to an entry from the one after it
            lcp = part["lcp"][::-1]
            found[low - len(part) + 1 : low] = lcp[:-1]
            if low < total:
                found[low] = lcp[-1]
        low -= len(part)
    if whole and total:
        found[0] = carry
    return order, found if whole else None


def types(text: np.ndarray, spill: Spill) -> np.ndarray:
    """Is each suffix larger than its successor? Equal letters take the type of what follows them."""
    n = len(text)
    larger = spill.array(n, bool)
    larger[n - 1], after = False, False
    for high in range(n - 1, 0, -CHUNK * 8):
        low = max(0, high - CHUNK * 8)
        falls, same = text[low:high] > text[low + 1 : high + 1], text[low:high] == text[low + 1 : high + 1]
        known = np.append(np.flatnonzero(~same), high - low)
        value = np.append(falls, after)
        larger[low:high] = value[known[np.searchsorted(known, np.arange(high - low))]]
        after = larger[low]
    return larger


def swept(names: np.ndarray, rising: bool, wanted: np.ndarray, seeds: np.ndarray, top: int, ranges: np.ndarray, spill: Spill, whole: bool) -> np.ndarray:
    """One sweep over a text of names: the suffixes sent, in order of taking; whole: with the seeds.

    rising: from small names to large; otherwise from `top` down. seeds: in order of taking; what is sent to a name comes
    before its seeds. ranges: the range of each name, in order of taking.
    """
    kind = np.dtype(np.int32)
    number = int(ranges.max()) + 1
    queues, out = [Queue(spill, kind) for _ in range(number)], Queue(spill, kind)

    def key(at: np.ndarray) -> np.ndarray:
        return names[at] if rising else top - names[at]

    # A run of one name sends itself on: from each position, where its run ends.
    same = wanted[:-1] & (names[1:] == names[:-1])
    ends = spill.array(len(names), np.int32)
    ends[:] = np.arange(len(names), dtype=np.int32)
    ends[1:][same] = 0
    np.maximum.accumulate(ends, out=ends)
    cuts = np.searchsorted(ranges[names[seeds]], np.arange(number + 1)) if len(seeds) else np.zeros(number + 1, int)
    for r in range(number):
        sent = list(queues[r].taken())
        at = np.concatenate(sent) if sent else np.zeros(0, np.int32)
        own = seeds[cuts[r] : cuts[r + 1]]
        at, rank = np.concatenate((at, own)), np.concatenate((key(at) * 2, key(own) * 2 + 1))
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        far, look = [], LOOK
        while len(at):
            head, ranks = at[:look], rank[:look]
            end = ends[head]
            before = end - 1  # the first letter's is the last one's, which nobody wants
            sends = wanted[before]
            target = np.where(sends, key(before) * 2, NEVER)
            # The longest lot of whole names that sends nothing into itself.
            late = np.minimum.accumulate(target) <= ranks
            lot = int(late.argmax())
            if not late[lot]:
                lot = len(head)
            if lot < len(at) and rank[lot - 1] == rank[lot]:
                lot = int(np.searchsorted(ranks, ranks[lot - 1])) or int(np.searchsorted(rank, rank[0], "right"))
                if lot > len(head):
                    look = lot
                    continue
            head, ranks, end, sends, before = head[:lot], ranks[:lot], end[:lot], sends[:lot], before[:lot]
            more = head - end
            taken = head if whole else head[ranks & 1 == 0]
            if more.any():  # of each name all first ones, then all second ones of runs, and so on
                turn = np.arange(int(more.sum()) + lot) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                which = np.repeat(np.arange(lot), more + 1)
                order = np.lexsort((turn, ranks[which]))
                taken = (head[which] - turn)[order].astype(np.int32)
                if not whole:
                    taken = taken[ranks[which][order] & 1 == 0]
                order = np.lexsort((more, ranks))
                sends, before = sends[order], before[order]
            if len(taken):
                out.put(taken)
            new = before[sends]
            at, rank = at[lot:], rank[lot:]
            look = LOOK
            inside = ranges[names[new]] == r
            if inside.any():
                far.append(new[~inside])
                new = new[inside]
                where = key(new) * 2
                order = np.argsort(where, kind="stable")
                new, where = new[order], where[order]
                spot = np.searchsorted(rank, where, "right")
                at, rank = np.insert(at, spot, new), np.insert(rank, spot, where)
            else:
                far.append(new)
        new = np.concatenate(far) if far else at
        if len(new):
            place = ranges[names[new]]
            order = np.argsort(place, kind="stable")
            new, place = new[order], place[order]
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(place)).tolist(), strict=True):
                queues[place[a]].put(new[a:b])
    result, low = spill.array(out.size, np.int32), 0
    for part in out.taken():
        result[low : low + len(part)] = part
        low += len(part)
    return result


def name_order(names: np.ndarray, cap: int, spill: Spill) -> np.ndarray:
    """The suffixes of a text of names in order of their first `cap` names; its last name is 0 and unique."""
    n, top = len(names), int(names.max())
    if cap <= DIRECT and n * 4 * (cap + 4) <= spill.memory:
        padded = np.concatenate((names, np.zeros(cap, names.dtype)))
        return np.lexsort([padded[k : n + k] for k in range(cap - 1, -1, -1)]).astype(np.int32)
    larger = types(names, spill)
    smaller = ~larger
    smaller[n - 1] = False  # nothing precedes the first letter
    size = np.bincount(names, minlength=top + 1)
    width = min(RANGE, max(RANGE >> 3, n >> 7, 1))
    up = ((np.cumsum(size) - 1) // width).astype(np.int32)
    down = ((np.cumsum(size[::-1]) - 1) // width).astype(np.int32)[::-1]

    def induced(seeds: np.ndarray, whole: bool) -> np.ndarray:
        lower = swept(names, True, larger, seeds, top, up, spill, False)
        return swept(names, False, smaller, lower[::-1], top, down, spill, whole)[::-1]

    lms = (np.flatnonzero(~larger[1:] & larger[:-1]) + 1).astype(np.int32)
    loose = lms[np.argsort(names[lms], kind="stable")]
    order = lms_order(names, lms, induced(loose, False), cap, spill)
    return np.concatenate((np.array([n - 1], np.int32), induced(order, True)))


def lms_order(text: np.ndarray, lms: np.ndarray, sorted_s: np.ndarray, cap: int, spill: Spill) -> np.ndarray:
    """The LMS suffixes in order of their first `cap` letters, from the S suffixes in order of their pieces."""
    n = len(text)
    flag = spill.array(n, bool, 0)
    flag[lms] = True
    pieces = np.concatenate((lms[-1:], sorted_s[flag[sorted_s]]))
    number = np.empty(len(lms), np.int32)  # of each LMS position, in order of text
    which = spill.array(n, np.int32)
    which[lms] = np.arange(len(lms), dtype=np.int32)
    rank = which[pieces]
    length = np.append(np.diff(lms), 0)[rank]
    same = np.zeros(len(pieces), bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    live = live[live > 1]  # the last piece, of the end alone, is itself
    x, y, k = pieces[live].astype(np.int64), pieces[live - 1].astype(np.int64), 0
    while len(live):
        going = text[x] == text[y]
        live, x, y = live[going], x[going], y[going]
        done = length[live] == k
        same[live[done]] = True
        live, x, y = live[~done], x[~done] + 1, y[~done] + 1
        k += 1
    number[rank] = np.cumsum(~same) - 1
    if same.any() and cap > 2:
        return lms[name_order(number, (cap + 1) // 2, spill)]
    return lms[np.argsort(number, kind="stable")]


def sort(text: np.ndarray, letters: int, cap: int, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `cap` letters, common prefix with the one before, up to cap); cap: 255 at most.

    The last letter must be 0 and occur nowhere else. memory: bytes of queues, and of a single array, that aren't on disk.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    spill = Spill(memory)
    try:
        larger = types(text, spill)
        lms = (np.flatnonzero(~larger[1:] & larger[:-1]) + 1).astype(np.int32)

        def by_letter(order: np.ndarray) -> list[np.ndarray]:
            cuts = np.searchsorted(text[order], np.arange(letters + 1))
            return [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

        loose = by_letter(lms[np.argsort(text[lms], kind="stable")])
        pieces, _ = induce(text, larger, loose, None, letters, cap, spill)
        order = lms_order(text, lms, pieces, cap, spill)
        shared = np.append(np.uint8(0), common(text, order[:-1], order[1:], cap))
        at, seeds, prefixes = 0, by_letter(order), []
        for s in seeds:
            prefixes.append(shared[at : at + len(s)].copy())
            at += len(s)
        found, lcp = induce(text, larger, seeds, prefixes, letters, cap, spill)
        whole, both = spill.array(n, np.int32), spill.array(n, np.uint8)
        whole[0], both[0] = n - 1, 0
        whole[1:], both[1:] = found, lcp
        return whole, both
    finally:
        spill.close()
