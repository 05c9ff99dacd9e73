"""Conversation tries, spelling variants and word passages against brute force and SQL, on hard and on empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodestone.llm import factors, prefixes, queries, spelling

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df = queries.queries()[name](spark, FOLDER)
    assert rows(df) == sorted(con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall(), key=str)


# 11: conversation prefix trie


def brute_trie(turns):
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(own)] for c, own in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:])
    nodes, children = {}, {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in below)
    ends = lambda p: sha(",".join(str(c) for c in sorted(nodes[p]) if built[c] == p))
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in nodes.items()), key=str)


@pytest.fixture(scope="module")
def conversations():
    rng, out = random.Random(1), []
    for c in range(-7, 150):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 30, 12])):
            out.append((c, None if t == 0 and c % 3 else t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "b"]) if c % 4 else "hot é"))
    return [*out, (200, None, None, None), (200, None, "", ""), *[(300, 1, "user", None)] * 3, (None, 1, "u", "x"), (401, 2, "a", "y"), (401, 2, "a", "x"), (401, 2, "A", "x")]


@pytest.mark.parametrize(("memory", "range_turns"), [(prefixes.MEMORY, prefixes.RANGE_TURNS), (2000, 40), (3000, 100_000)])
def test_trie(spark, conversations, memory, range_turns):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"1 as `{c}`" for c in ("key", "range", "depth", "step", "path", "sizes", "turns", "t", "h", "base", "size")))
    assert rows(prefixes.trie(prefixes.regrafted(df), memory, range_turns)) == brute_trie(conversations)
    assert prefixes.trie(prefixes.regrafted(df.where("false"))).count() == 0


def test_equal_conversations_over_ranges(spark):
    """A third of all conversations are one; they fill several ranges, and their ids hash in order."""
    turns = [(5 * c, t, "user", "same" if c % 3 == 0 else f"{c % 7}") for c in range(3000) for t in range(4)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert rows(prefixes.trie(prefixes.turns(df), 1 << 14, 2000)) == brute_trie([(5 * c, t, r, x) for c, (t, r, x) in ((i[0] // 5, i[1:]) for i in turns)])


def test_loser_tree():
    """Runs that carry shared prefixes merge into one that does, without comparing what is known to be shared."""
    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs = prefixes.Runs(1 << 40)
        whole = []
        for i in range(400):
            path = b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(9)))
            runs.add(path, i, [1] * (len(path) // 16))
            whole.append((path, i))
            if k > 1 and i % (400 // k) == 0:
                runs.spill()
        got = list(runs.merged())
        assert [e[:2] for _, e in got] == sorted(whole)
        assert [n for n, _ in got] == [0, *(prefixes.common(a[1][0], b[1][0], 0) for a, b in zip(got, got[1:], strict=False))]


# 12: spelling variants


def brute_spelling(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near, alike = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            alike.setdefault((i, less), []).append(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= {*group} - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("nodes", "lot"), [(spelling.SHARD_NODES, spelling.LOT), (500, 3)])
def test_spelling(spark, nodes, lot):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÉé×") for _ in range(rng.randrange(3, 8)))
    docs = [(rng.choice([i, None]), " ".join(word() for _ in range(rng.randrange(300)))) for i in range(40)]
    docs += [(1, None), (2, ""), (3, "\0 \U0001f642 K" + "x" * 5000 + " " + "x" * 5001), *[(3, "X" * 5000 + " " + "x" * 5001)] * 3, *[(9, "one two three fours fives")] * 4]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", *(f"1 as `{c}`" for c in ("word", "n", "form", "root", "first", "trie", "best")))
    assert rows(spelling.variants(df, nodes=nodes, lot=lot)) == brute_spelling(docs)
    assert spelling.variants(df.where("false")).count() == 0


def test_trie_walk():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))).encode() for _ in range(300)})
    trie = spelling.Trie.unpacked(spelling.Trie.of(words, list(range(1, len(words) + 1))).packed())
    for w in [*words[::3], b"aaaaaaa", b"z", b"abcabc"]:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in (b"a", b"b", b"c") if j <= len(w)}
        assert trie.near(w) == {x: i + 1 for i, x in enumerate(words) if x in edits and x != w}


# 13: word passages


def brute_factors(docs, length):
    first, split = {}, [(2**63 if d is None else d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            first[window] = min(first.get(window, 2**64), d)
    out = []
    for (doc, _), (d, w) in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    say = lambda n: [rng.choice([*(f"w{i}" for i in range(40)), "é", "日本"]) for _ in range(n)]
    pool, out = [say(rng.randrange(8, 60)) for _ in range(12)], []
    for i in range(300):
        words = [w for _ in range(rng.randrange(6)) for w in (rng.choice(pool) if rng.random() < 0.6 else say(rng.randrange(1, 30)))]
        out.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n", "  ", "\t", "\x0b"]).join(words) if rng.random() < 0.97 else None))
    long = " ".join(say(20_000))
    return [*out, *out[:20], (900, long), (901, long + " x"), (902, "   \n"), (903, "nbsp\xa0is\x1cno space"), (904, "")]


@pytest.mark.parametrize(("length", "gram", "block"), [(12, 4, 1 << 19), (12, 4, 60), (5, 2, 30)])
def test_factors(spark, passages, length, gram, block):
    """Blocks of 60 and 30 words seal references many times."""
    df = spark.createDataFrame(passages, DOCS).selectExpr("*", *(f"1 as `{c}`" for c in ("tag", "rep", "shard", "anchor", "content", "sha", "spans", "n_words", "c1")))
    assert rows(factors.remove(df, length, gram, block), 4) == brute_factors(passages, length)
    assert factors.remove(df.where("false")).count() == 0


def test_frequent_runs(spark, monkeypatch):
    """A line of 30 words that every text holds, each with other neighbours, doesn't become the anchor of many passages; results stay."""
    rng = random.Random(8)
    line = [f"l{i}" for i in range(30)]
    docs = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(60)] + line + [f"b{rng.randrange(50)}" for _ in range(60)])) for i in range(400)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(50)]
    monkeypatch.setattr(factors, "HEAT_SHARE", 1)
    df = spark.createDataFrame(docs, DOCS)
    held = df.selectExpr("doc_id", "text", "xxhash64(text) as tag")
    heat = factors.frequent(held, factors.GRAM, factors.LENGTH)
    assert heat is not None and 0 < heat.sum() < 30
    block = factors.Block([t.encode() for _, t in docs[:400]])
    common = lambda hot: Counter(factors.entries(block, 50, factors.GRAM, hot)[0].tolist()).most_common(1)[0][1]
    assert 2 * common(heat) < common(None)
    assert rows(factors.remove(df), 4) == brute_factors(docs, 50)


def test_reference_factors():
    """Factors follow the reference beyond a window, stop at a difference, and windows over their ends are looked up."""
    reference = factors.Reference(3, 1 << 10)
    seeds = lambda w: [hash(tuple(w[i : i + 3])) % 2**64 for i in range(len(w) - 2)]
    first, second = [1, 2, 3, 4, 5, 6], [4, 5, 6, 7, 8]
    assert reference.parse(first, seeds(first), 10) == [(0, 4, 10)]
    assert reference.parse(second, seeds(second), 11) == [(0, 1, 10), (1, 3, 11)]
    whole = [9, 2, 3, 4, 5, 6, 7, 8, 1]
    assert reference.parse(whole, seeds(whole), 12) == [(0, 1, 12), (1, 4, 10), (4, 6, 11), (6, 7, 12)]
