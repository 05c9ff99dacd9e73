"""Quality classifier: a factorisation machine.

Inputs are hashed words (lower-cased, normalised frequencies), structure statistics and the table's own length field,
each statistic as one of eight bins. The score of a text is linear in its non-zero inputs, pairs included:
sum over pairs <v_i, v_j> x_i x_j = half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.

The model is fitted on a bounded sample of labelled rows (SAMPLE, the least hashes of doc_id) and sent to the executors:
(WORDS + bins) x (FACTORS + 1) floats, about 160 KB. Labels, lang, source and doc_id are never inputs.

Defined cases: a null or empty text has its statistics alone and still gets a score; a null n_chars has a bin of its own;
rows whose label is null don't teach; without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, doc_blocks, raw_text, released

WORDS, FACTORS, BINS, SAMPLE, THRESHOLD = 4096, 8, 8, 4000, 0.3

# Byte classes for the statistics.
UPPER, LOWER, DIGIT, MARK, SYMBOL, HIGH, LINE, OTHER = range(8)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:], CLASS[10] = UPPER, LOWER, DIGIT, HIGH, LINE
CLASS[list(b".,;:'\"-()?")] = MARK
CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = SYMBOL


def folds(doc_id):
    """The fold of a row, 0 to 4; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word bucket, value) of a block's hashed words, and its statistics, a row a text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    key, times = np.unique(words.doc * WORDS + (words.hash % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    doc, bucket = key // WORDS, key % WORDS
    norm = np.sqrt(np.bincount(doc, times.astype(float) ** 2, n))
    value = times / norm[doc] if len(doc) else times.astype(float)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 8 + CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    blank = np.bincount(owner, SPACE[data], n)
    count = np.maximum(words.count, 1)
    length = words.end - words.start
    solid = np.maximum(size - blank, 1)
    letters = np.maximum(kinds[:, UPPER] + kinds[:, LOWER] + kinds[:, HIGH], 1)
    tail = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    variety = np.bincount(doc, minlength=n) / count
    stats = np.column_stack(
        [
            np.log1p(size), np.log1p(words.count), np.bincount(words.doc, length, n) / count,
            kinds[:, UPPER] / letters, kinds[:, HIGH] / solid, kinds[:, DIGIT] / solid, kinds[:, MARK] / solid, kinds[:, SYMBOL] / solid,
            kinds[:, LINE] / count, variety, np.bincount(words.doc, length == 1, n) / count,
            np.bincount(words.doc, CLASS[tail] == SYMBOL, n) / count, np.where(n_chars >= 0, np.log1p(np.maximum(n_chars, 0)), np.nan),
        ]
    )
    return doc, bucket, value, stats


@dataclass
class Machine:
    edges: np.ndarray  # of the statistics' bins
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """Positions of each text's bins among the inputs; a missing statistic has the last bin."""
        out = np.empty(stats.shape, np.int64)
        for j in range(stats.shape[1]):
            bins = np.searchsorted(self.edges[j], stats[:, j], "right")
            out[:, j] = WORDS + j * (BINS + 1) + np.where(np.isnan(stats[:, j]), BINS, bins)
        return out

    def score(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """The probability of label 1, in time linear in the inputs."""
        n, m = stats.shape
        bins, x = self.binned(stats), 1 / np.sqrt(m)
        out = self.bias + np.bincount(doc, self.linear[bucket] * value, n) + self.linear[bins].sum(axis=1) * x
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            part, own = v[bucket] * value, v[bins] * x
            both = np.bincount(doc, part, n) + own.sum(axis=1)
            out += 0.5 * (both**2 - np.bincount(doc, part**2, n) - (own**2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 40, rate: float = 0.03, decay: float = 2e-4) -> Machine:
    """Log loss by Adam over (buckets, values, statistics, label) rows, always in the same order."""
    if not rows:
        return Machine(np.zeros((13, BINS - 1)), 0.0, np.zeros(WORDS + 13 * (BINS + 1)), np.zeros((WORDS + 13 * (BINS + 1), FACTORS)))
    stats = np.array([r[2] for r in rows])
    y = np.array([r[3] for r in rows], float)
    m = stats.shape[1]
    with np.errstate(all="ignore"):
        edges = np.array([np.quantile(c[~np.isnan(c)], np.arange(1, BINS) / BINS) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in stats.T])
    size = WORDS + m * (BINS + 1)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    machine = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), np.random.default_rng(7).normal(0, 0.05, (size, FACTORS)))
    if y.min() == y.max():
        machine.factors[:] = 0
        return machine
    x = np.zeros((len(rows), size), np.float32)
    for i, (bucket, value, _, _) in enumerate(rows):
        x[i, bucket] = value
    np.put_along_axis(x, machine.binned(stats), np.float32(1 / np.sqrt(m)), axis=1)
    order = np.random.default_rng(11)
    params = [np.array([machine.bias]), machine.linear, machine.factors]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for some in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 128)):
            a = x[some].astype(float)
            square = a * a
            sums = a @ params[2]
            out = params[0] + a @ params[1] + 0.5 * (sums**2 - square @ params[2] ** 2).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[some]) / len(some)
            grads = [np.array([slope.sum()]), a.T @ slope + decay * params[1], a.T @ (slope[:, None] * sums) - params[2] * (square.T @ slope)[:, None] + decay * params[2]]
            step += 1
            for p, g, u, w in zip(params, grads, first, second, strict=True):
                u += 0.1 * (g - u)
                w += 0.001 * (g * g - w)
                p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(params[0][0])
    return machine


def _columns(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", F.coalesce(length, F.lit(-1)).alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most `sample` labelled rows of the folds 1 to 4; a document's label is the majority of its rows'."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (folds("doc_id") != 0))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column(1))
            n_chars = batch.column(2).to_numpy(zero_copy_only=False)
            for low, high in doc_blocks(offsets):
                doc, bucket, value, stats = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n_chars[low:high])
                ends = np.searchsorted(doc, np.arange(high - low + 1))
                pieces = [(bucket[a:b].tolist(), value[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(3).slice(low, high - low), pa.array([p[0] for p in pieces], pa.list_(pa.int32())), pa.array([p[1] for p in pieces], pa.list_(pa.float64())), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                    ["doc_id", "label", "bucket", "value", "stats"],
                )

    rows = _columns(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of 12 bytes
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "n_chars")).alias("row")).select("doc_id", "row.text", "row.n_chars", "label")
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = rows.mapInArrow(released(run), f"doc_id {kind}, label int, bucket array<int>, value array<double>, stats array<double>").collect()
    held.sort(key=lambda r: (r.doc_id, r.bucket, r.value))
    return fit([(np.array(r.bucket, np.int64), np.array(r.value), np.array(r.stats, float), r.label) for r in held[:sample]])


def scores(machine: Machine, column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    data, offsets = raw_text(column)
    out = [machine.score(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_chars[a:b])) for a, b in doc_blocks(offsets)]
    return np.concatenate(out) if out else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        for batch in batches:
            score = scores(held.value, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _columns(docs).mapInArrow(released(run), f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", (folds("doc_id") == 0).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows that the classifier doesn't reject, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    names = docs.columns
    spot, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            n_chars = np.full(len(batch), -1) if length is None else batch.column(length).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(scores(held.value, batch.column(spot), n_chars) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
