"""Summaries of texts: their sentences as a graph by shared words, ranked by power iteration, the best kept in order.

Two sentences are as near as the cosine of their sets of words. No pair is made: a round sends each sentence's rank to its
words and gathers it from them, so a text takes time and memory in proportion to its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENDS = re.compile(r"[.!?\n]+")
WORD = re.compile("[a-z0-9à-öø-ÿ]+")
LONGER, DAMPING, ROUNDS = 3, 0.85, 8  # words that count are longer; the share of a rank that follows the graph


def sentences(text: str) -> tuple[list[str], list[list[str]]]:
    """The sentences that hold a word that counts, and their distinct ones."""
    out, words = [], []
    for part in ENDS.split(text):
        own = sorted({w for w in WORD.findall(part.lower()) if len(w) > LONGER})
        if own:
            out.append(part.strip(" "))
            words.append(own)
    return out, words


def ranks(words: list[list[str]], rounds: int = ROUNDS) -> np.ndarray:
    n = len(words)
    if not n:
        return np.zeros(0)
    number: dict[str, int] = {}
    size = np.array([len(w) for w in words])
    who = np.repeat(np.arange(n), size)
    what = np.array([number.setdefault(w, len(number)) for own in words for w in own])
    share = 1.0 / np.sqrt(size[who])
    gather = lambda x: np.bincount(who, share * np.bincount(what, share * x[who], len(number))[what], n) - x  # noqa: E731  a sentence isn't its own neighbour
    degree = np.round(gather(np.ones(n)), 12)
    flow = np.where(degree > 0, 1.0 / np.where(degree > 0, degree, 1.0), 0.0)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        rank = (1.0 - DAMPING) / n + DAMPING * gather(rank * flow)
    return rank


def summary(text: str, most: int, rounds: int = ROUNDS) -> tuple[str, int]:
    """(the best sentences in order, joined by a space; how many the text has). Ties go to the earlier one."""
    parts, words = sentences(text)
    best = np.sort(np.lexsort((np.arange(len(parts)), -np.round(ranks(words, rounds), 9)))[:most])
    return " ".join(parts[i] for i in best), len(parts)


def summarised(docs: DataFrame, most: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, summary, sentences) of each text (doc_id, text); of a null or empty one the empty summary."""

    def run(batches):
        for batch in batches:
            found = [summary(t or "", most, rounds) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "summary", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, summary string, sentences long")
