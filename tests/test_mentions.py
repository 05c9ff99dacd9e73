"""Dictionary terms in texts against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import mentions


def plain(docs, dictionary):
    terms = {}
    for term, kind in dictionary:
        key = tuple(re.findall(mentions.TOKEN, term.lower()))
        if key:
            terms[key] = min(terms.get(key, (kind, term)), (kind, term))
    out = []
    for doc, text in docs:
        words, kept, at = re.findall(mentions.TOKEN, (text or "").lower()), [], 0
        while at < len(words):
            n = max((len(k) for k in terms if tuple(words[at : at + len(k)]) == k), default=0)
            if n:
                kept.append((at, n, *reversed(terms[tuple(words[at : at + n])])))
            at += max(1, n)
        for i, (at, n, term, kind) in enumerate(kept):
            near = any(0 <= j < len(kept) and kept[j][2] != term and (at - sum(kept[j][:2]) < 10 if j < i else kept[j][0] - at - n < 10) for j in (i - 1, i + 1))
            points = 50 + 20 * (n > 1) + 20 * (sum(k[2] == term for k in kept) > 1) + 10 * near
            out.append((doc, at, n, term, kind, points / 100))
    return sorted(out)


@pytest.mark.parametrize("small", [mentions.SMALL_TRIE, 0])
def test_mentions(spark, monkeypatch, small):
    """Nested and overlapping terms, one of two types, texts without any; levels that are broadcast, and that are shuffled."""
    monkeypatch.setattr(mentions, "SMALL_TRIE", small)
    rng = random.Random(3)
    words = ["New", "york", "city", "hall", "of", "fame", "Ünder", "x9"]
    dictionary = [("New York", "location"), ("New York City", "location"), ("city hall", "location"), ("hall of fame", "concept"), ("FAME", "person"), ("ünder x9 of", "document"), ("new york", "concept"), ("--", "date")]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "\n"]) for _ in range(rng.randrange(60)))) for i in range(60)] + [(90, None), (91, ""), (92, "fame " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as node", "3 as term")
    held = spark.createDataFrame(dictionary, "term string, type string")
    got = mentions.scored(mentions.settled(mentions.found(df, held)))
    assert sorted(tuple(r) for r in got.select("doc_id", "pos", "n", "term", "type", "confidence").collect()) == plain(docs, dictionary)
    assert mentions.found(df, held.where("false")).count() == 0 and mentions.found(df.where("false"), held).count() == 0
    rows = mentions.entity_rows(mentions.extracted(df, held), F.lit(7), F.lit("me")).where("doc_id = 92").collect()
    assert [(r.space_id, r.entity_type, r.name, r.properties) for r in rows] == [(7, "person", "FAME", '{"confidence":0.7,"mentions":3000,"first_pos":0}')]


def test_terms_have_a_bound(spark):
    df = spark.createDataFrame([("a b c", "date")], "term string, type string")
    assert {r.node for r in mentions.trie(df, 3).collect()} == {"a", "a b", "a b c"}
    with pytest.raises(Exception, match="over 2 tokens"):
        mentions.trie(df, 2).collect()
