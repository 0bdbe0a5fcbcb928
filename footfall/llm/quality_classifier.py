"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in vectorised slices and never from label, language, source
or id. The trees are fit on a bounded sample of the labelled training rows (``SAMPLE_ROWS``, the
rows with the smallest hash of their id), from histograms of at most 64 bins a statistic, and are
flattened into arrays of complete binary trees, so that scoring is ``depth`` gathers a tree for a
whole slice. Scoring reads every document in one pass without a shuffle.

Null texts score as empty ones; rows with a null label, and labels of documents that are not in the
table, are not learnt from; of repeated labels the smallest counts; repeated documents score alike.
Without labels of both classes the score is the share of label 1 (0.5 without any). An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import crc_mod
from footfall.llm.quality_rules import SYMBOL, base_counts, docs_type
from footfall.llm.textops import SPACE, hash_spans, mix, per_text, text_slices, words

SAMPLE_ROWS = 30_000
BINS = 64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_FINAL = np.zeros(256, bool)
_FINAL[[ord(c) for c in ".!?"]] = True


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per text, float32; an empty text has zeros."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(np.float64)
    counts = base_counts(raw, off)
    w = np.maximum(counts["n_words"], 1).astype(np.float64)
    starts, ends, first = words(raw, off)
    length = ends - starts
    text = np.repeat(np.arange(n), np.diff(first))
    key = mix(hash_spans(raw, starts, ends) ^ mix(text.astype(np.uint64)))
    _, leader, number = np.unique(key, return_index=True, return_counts=True)
    owner = text[leader]
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, number)
    once = np.bincount(owner[number == 1], minlength=n)
    same = np.zeros(len(starts), bool)
    if len(starts):
        h = hash_spans(raw, starts, ends)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, text, length)
    lines = per_text(raw == 10, off) + 1.0
    histogram = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 32 + SYMBOL[raw], minlength=32 * n).reshape(n, 32) / size[:, None]
    entropy = -(histogram * np.log2(np.maximum(histogram, 1e-9))).sum(axis=1)
    word_entropy = np.bincount(owner, -number * np.log2(number), minlength=n) / w + np.log2(w)
    spread = np.sqrt(np.maximum(np.bincount(text, length.astype(np.float64) ** 2, minlength=n) / w - (np.bincount(text, length, minlength=n) / w) ** 2, 0))
    columns = [
        np.log1p(np.diff(off)), np.log1p(counts["n_words"]), counts["word_chars"] / w, spread, np.log1p(longest),
        counts["n_symbols"] / w, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / w, distinct / w, top / w, once / w,
        np.bincount(text[same], minlength=n) / w, np.log1p(lines), w / lines, per_text(_UPPER[raw], off) / size,
        per_text(_FINAL[raw], off) / w, per_text(SPACE[raw], off) / w, entropy, word_entropy,
        np.bincount(text[length <= 3], minlength=n) / w, np.bincount(text[length >= 12], minlength=n) / w,
        *histogram.T,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


N_STATISTICS = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


@dataclass
class Trees:
    """``feature`` and ``threshold`` [tree, inner node], ``leaf`` [tree, leaf], nodes in heap order."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner] if len(x) else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, l2: float = 2.0, min_rows: int = 10) -> Trees:
    """Second-order boosting of the logistic loss with quantile-binned statistics."""
    inner, n, m = (1 << depth) - 1, len(y), x.shape[1] if x.ndim == 2 else N_STATISTICS
    share = float(y.mean()) if n else 0.5
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    if not n or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3) if n else 0.5
        empty.base = float(np.log(share / (1 - share)))
        return empty
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for k in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(m) * BINS
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            width = 1 << level
            cells = (node[:, None] * (m * BINS) + flat).ravel()
            total = width * m * BINS
            hist = [np.bincount(cells, np.repeat(v, m), minlength=total).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(cl < min_rows) | (ct - cl < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // BINS, best % BINS
            at = width - 1 + np.arange(width)
            feature[at] = np.where(good, f, 0)
            threshold[at] = [cuts[k][c] if ok and c < len(cuts[k]) else np.inf for k, c, ok in zip(f, b, good)]
            right = x[np.arange(n), feature[at][node]] > threshold[at][node]
            node = 2 * node + right
        value = rate * np.bincount(node, g, minlength=inner + 1) / (np.bincount(node, h, minlength=inner + 1) + l2)
        margin += value[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def with_statistics(docs: DataFrame) -> DataFrame:
    """The rows with their statistics as an array<float> column instead of the text."""
    rest = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [b.column(k) for k, c in enumerate(docs_columns) if c != "text"]
            for i, j, raw, off in text_slices(b.column(at)):
                x = statistics(raw, off)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in keep), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))], names=[*rest, "statistics"])

    docs_columns = list(docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, statistics array<float>")


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, label) of the bounded sample: training rows only (held-out ids are left out)."""
    usable = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
              .groupBy("doc_id").agg(F.min("quality").alias("label")))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Fit the trees on the sample; its statistics (at most ``sample_rows`` short rows) come to the driver."""
    sample = training_rows(docs, labels, sample_rows)
    # the sample has at most sample_rows pairs of numbers, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = with_statistics(chosen.select("doc_id", "label", "text")).toArrow()
    pairs = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), range(rows.num_rows)))
    if not pairs:
        return fit_trees(np.zeros((0, N_STATISTICS), np.float32), np.zeros(0), **options)
    x = np.asarray(rows["statistics"].combine_chunks().flatten()).reshape(-1, N_STATISTICS)
    order = np.array([p[2] for p in pairs])
    return fit_trees(x[order], np.array([p[1] for p in pairs], np.float64), **options)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", docs_type(docs)), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(shared.value.score(statistics(raw, off)))], schema=schema)

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
