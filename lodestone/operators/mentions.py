"""Entities named in texts: a dictionary's terms found by a trie held as a table, one join a token, overlaps settled, with a confidence from what stands around.

Tokens are runs of letters and digits, in lower case. A term is found wherever its tokens follow each other; of terms that
begin at one token the longest counts, and of overlapping ones the first. A dictionary (term, type) may name a term more
than once: its least type counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import folds

TOKEN = "[a-z0-9à-öø-ÿ]+"
MOST_TOKENS, SMALL_TRIE, NEARBY = 16, 200_000, 10  # of a term; nodes of a level that are broadcast; tokens that count as nearby


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def trie(dictionary: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """(depth, parent, token, node, term, type): an edge of each prefix of the terms; term and type where one ends. Nodes are named by their prefix. Longer terms than `most` tokens are an error."""
    words = dictionary.select("term", "type", tokens(F.col("term")).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("words", F.when(F.size("words") <= most, F.col("words")).otherwise(F.raise_error(F.concat(F.lit(f"over {most} tokens: "), "term")).cast("array<string>")))
    prefix = lambda d: F.array_join(F.slice("words", 1, d), " ")
    edge = F.transform(F.sequence(F.lit(1), F.size("words")), lambda d: F.struct(d.alias("depth"), prefix(d - 1).alias("parent"), F.element_at("words", d).alias("token"), prefix(d).alias("node"), F.when(d == F.size("words"), F.struct("type", "term")).alias("end")))
    edges = words.select(F.explode(edge).alias("e")).select("e.*")
    held = edges.groupBy("depth", "parent", "token", "node").agg(F.min("end").alias("end"))
    return held.select("depth", "parent", "token", "node", "end.term", "end.type")


def found(docs: DataFrame, dictionary: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, pos, n, term, type): the longest term that begins at each token."""
    edges = trie(dictionary, most).persist()
    levels = {r.depth: r.n for r in edges.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a depth
    if not levels:
        return docs.select("doc_id").where("false").select("doc_id", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit("").alias("term"), F.lit("").alias("type"))
    deepest = max(levels)
    # Bound by a lambda, so that a text is cut into tokens once, not once a token.
    ahead = lambda words: F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.slice(words, i + 1, deepest).alias("rest")))
    state = docs.select("doc_id", F.explode(F.flatten(F.transform(F.array(tokens(F.col("text"))), ahead))).alias("a")).select("doc_id", "a.pos", "a.rest")
    state = state.withColumn("node", F.lit("")).withColumn("best", F.lit(None).cast("struct<n:int,term:string,type:string>"))
    for depth in range(1, deepest + 1):
        level = edges.where(F.col("depth") == depth).select(F.col("parent").alias("node"), F.col("token").alias("_token"), F.col("node").alias("_node"), "term", "type")
        level = F.broadcast(level) if levels[depth] <= SMALL_TRIE else level
        # What has left the trie gets a key of its own, so that it doesn't meet in one task.
        here = state.withColumn("node", F.coalesce("node", F.concat(F.lit("\0"), F.col("pos").cast("string")))).withColumn("_token", F.coalesce(F.get("rest", F.lit(depth - 1)), F.lit("\0")))
        met = here.join(level, ["node", "_token"], "inner" if depth == 1 else "left")
        best = F.when(F.col("term").isNotNull(), F.struct(F.lit(depth).alias("n"), "term", "type")).otherwise(F.col("best"))
        state = met.select("doc_id", "pos", "rest", F.col("_node").alias("node"), best.alias("best"))
    return state.where("best is not null").select("doc_id", "pos", "best.n", "best.term", "best.type")


def _apart(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    """A mention counts if it begins at the end of the last that counts, or later."""
    pos, n = row
    end = -1 if state is None else state[0]
    return ((pos + n,), (True,)) if pos >= end else ((end,), (False,))


def settled(mentions: DataFrame) -> DataFrame:
    """Mentions without those that overlap an earlier one that counts."""
    kept = folds.folded(mentions, "doc_id", ["pos"], ["pos", "n", "term", "type"], lambda s, r: (lambda x: (x[0], (r[1], r[2], r[3], x[1][0])))(_apart(s, r[:2])), "n int, term string, type string, kept boolean")
    return kept.where("kept").drop("kept")


def scored(mentions: DataFrame, nearby: int = NEARBY) -> DataFrame:
    """With a confidence: half, and more for a term of several tokens, one that the text names again, and one that has another term nearby."""
    near, again = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id", "term")
    before = (F.col("pos") - F.lag(F.col("pos") + F.col("n")).over(near) < nearby) & (F.lag("term").over(near) != F.col("term"))
    after = (F.lead("pos").over(near) - F.col("pos") - F.col("n") < nearby) & (F.lead("term").over(near) != F.col("term"))
    points = 50 + F.when(F.col("n") > 1, 20).otherwise(0) + F.when(F.count(F.lit(1)).over(again) > 1, 20).otherwise(0) + F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), 10).otherwise(0)
    return mentions.withColumn("confidence", points / 100.0)


def extracted(docs: DataFrame, dictionary: DataFrame, at_least: float = 0.7, most: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, type, name, mentions, first_pos, confidence): the entities that a text names with enough confidence, its best mention's."""
    rows = scored(settled(found(docs, dictionary, most))).where(F.col("confidence") >= at_least)
    return rows.groupBy("doc_id", "type", F.col("term").alias("name")).agg(F.count(F.lit(1)).alias("mentions"), F.min("pos").cast("long").alias("first_pos"), F.max("confidence").alias("confidence"))


def entity_rows(extracted: DataFrame, space_id: Column, created_by: Column) -> DataFrame:
    """New rows of the entity table, with what they rest on as properties."""
    properties = F.to_json(F.struct("confidence", "mentions", "first_pos"))
    return extracted.select("doc_id", space_id.alias("space_id"), F.col("type").alias("entity_type"), "name", properties.alias("properties"), created_by.alias("created_by"))
