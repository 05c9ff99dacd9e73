"""Connected components of an edge table by alternating large and small stars, each round cut by a written table; and the spanning pairs of a group in memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 200  # each about halves the longest path; a graph that takes more is an error, not a result


def _hubs(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node reachable from each node of (a, b) edges; nodes without an edge are left out."""
    held = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = scratch.table(held, f"{name}-0")
    state = None
    for k in range(1, ROUNDS):
        # Large star: larger neighbours of a node move to its least neighbour.
        arcs = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = arcs.join(_hubs(arcs), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        moved = moved.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        met = moved.join(_hubs(moved), "u")
        held = met.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        held = scratch.table(held, f"{name}-{k}")
        now = tuple(held.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(salt), "u", "v").cast("decimal(38,0)")) for salt in (1, 2))).first())
        scratch.drop(f"{name}-{k - 1}")
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spanning(comp: np.ndarray, near: Callable, hub: int, meet: int, linked: Callable | None = None) -> list[np.ndarray]:
    """[(member, member)] pairs, none with the hub, that reach from each first component on all its near members, breadth-first.

    near: (members, others) to a matrix of those that may be linked, at most `meet` at once. linked: decides pairs of members
    for sure; without it each near one counts. A member that is reached is not compared again.
    """
    left, out = np.ones(len(comp), bool), []
    by = np.argsort(comp, kind="stable")
    names, starts = np.unique(comp[by], return_index=True)
    ends = np.append(starts[1:], len(by))
    for which in range(len(names)):
        own = by[starts[which] : ends[which]]
        if not left[own[0]]:
            continue
        left[own] = False
        front, at = own, 0
        while at < len(front):
            rest = np.flatnonzero(left)
            if not len(rest):
                return out
            take = front[at : at + max(1, meet // len(rest))]
            at += len(take)
            close = near(take, rest)
            if hub >= 0:
                close[take == hub] = False
                close[:, rest == hub] = False
            hit = np.flatnonzero(close.any(axis=0))
            pairs = np.column_stack((take[close[:, hit].argmax(axis=0)], rest[hit]))
            if linked is not None:  # each member's candidates in turn, until one is a link
                sure = []
                while len(hit):
                    pairs = np.column_stack((take[close[:, hit].argmax(axis=0)], rest[hit]))
                    good = linked(pairs)
                    sure.append(pairs[good])
                    close[close[:, hit].argmax(axis=0), hit] = False
                    hit = hit[~good]
                    hit = hit[close[:, hit].any(axis=0)]
                pairs = np.concatenate(sure) if sure else pairs
            if len(pairs):
                out.append(pairs)
                joined = np.isin(comp, comp[pairs[:, 1]]) & left
                left[joined] = False
                front, at = np.concatenate((front[at:], np.flatnonzero(joined))), 0
    return out
