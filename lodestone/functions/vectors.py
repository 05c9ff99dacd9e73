"""Vector functions on array columns, in double precision and inside the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; exactly 1.0 where either vector is all zeros."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / scale)


def has_dimension(a: Column, n: int) -> Column:
    return F.coalesce(F.size(a) == n, F.lit(False))


def checked(a: Column, n: int) -> Column:
    """The vector itself; another dimension than n is an error."""
    return F.when(has_dimension(a, n), a).otherwise(F.raise_error(F.concat(F.lit(f"expected dimension {n}, got "), F.size(a).cast("string"))))


ROWS = 1024  # texts whose vectors are made at once


def _listed(parts: list[np.ndarray], dimensions: int) -> pa.Array:
    """Rows of numbers as one column of lists."""
    rows = np.concatenate([*parts, np.zeros((0, dimensions), np.float32)]).astype(np.float32, copy=False)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(dimensions)), pa.array(rows.ravel()))


def embed(text: Column, dimensions: int = 384) -> Column:
    """A stand-in for an embedding model: signed hashing of words, normalised to length 1. Any function of this shape may replace it.

    Words are hashed in the JVM; the signed counts of 1,024 texts are summed at once.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)

    @F.arrow_udf("array<float>")
    def summed(hashes: pa.Array) -> pa.Array:
        out = []
        for low in range(0, len(hashes), ROWS):
            some = hashes.slice(low, ROWS)
            size, flat = pc.list_value_length(some).to_numpy(zero_copy_only=False), some.flatten().to_numpy(zero_copy_only=False)
            spot = np.repeat(np.arange(len(size)), size) * dimensions + flat % dimensions
            v = np.bincount(spot, np.where(flat < 0, 1.0, -1.0), len(size) * dimensions).reshape(len(size), dimensions)
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out.append((v / np.where(n > 0, n, 1)).astype(np.float32))
        return _listed(out, dimensions)

    return summed(F.transform(words, lambda w: F.xxhash64(w)))


def word_counts(text: Column, dimensions: int = 384) -> Column:
    """An embedder without hashing that only Spark knows: signed counts of lower-case words by their MD5, as whole numbers."""

    @F.arrow_udf("array<float>")
    def summed(texts: pa.Array) -> pa.Array:
        known: dict[str, tuple[int, int]] = {}
        out = np.zeros((len(texts), dimensions), np.float32)
        for low in range(0, len(texts), ROWS):
            for i, text in enumerate(texts.slice(low, ROWS).to_pylist(), low):
                for word in filter(None, (text or "").split(" ")):
                    spot = known.get(word)
                    if spot is None:
                        digest = hashlib.md5(word.encode()).digest()
                        spot = known[word] = int.from_bytes(digest[:4], "big") % dimensions, 1 if digest[4] < 128 else -1
                    out[i, spot[0]] += spot[1]
        return _listed([out], dimensions)

    return summed(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))
