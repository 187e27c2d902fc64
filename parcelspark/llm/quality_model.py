"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features come from one numpy pass over each text. Trees are grown on a bounded, documented sample
of labelled rows (``TRAIN_ROWS``, chosen by hash order) and flattened into plain arrays; scoring
walks all rows through all trees at once with array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.llm import textkit as tk
from parcelspark.llm.docstats import statistics
from parcelspark.llm.store import arrow_rows

TRAIN_ROWS = 20_000     # bound of the labelled sample the trees are fitted on
BINS = 64
TREES, DEPTH, RATE, L2, MIN_HESSIAN = 60, 4, 0.2, 1.0, 2.0

FEATURES = ["log_words", "word_len", "distinct", "stutter", "repeat3", "dup5", "dup10", "dup_lines", "dup_line_chars",
            "symbols", "pipes", "bangs", "upper", "digits", "punct", "wide", "breaks", "words_per_line", "letters"]


def features(texts: list[bytes]) -> np.ndarray:
    """Feature matrix (texts x FEATURES), each a count ratio of the text itself."""
    s = statistics(texts)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1)
    word_chars, lines = np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    cols = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_distinct"] / words, s["n_stutter"] / words,
            s["n_repeat_words"] / words, s["dup_5gram_chars"] / word_chars, s["dup_10gram_chars"] / word_chars,
            s["n_dup_lines"] / lines, s["dup_line_chars"] / chars, s["n_symbols"] / words, s["n_pipes"] / words,
            s["n_bangs"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_punct"] / words,
            s["n_wide"] / chars, s["n_breaks"] / words, s["n_words"] / lines,
            (s["n_lower"] + s["n_upper"] + s["n_wide"]) / chars]
    return np.stack(cols, axis=1).astype(np.float64)


@dataclass
class Forest:
    """Trees as flat arrays; a leaf points at itself on both sides."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting on the logistic loss over quantile bins. With no rows or one class the
    forest is empty and the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []          # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            _grow(nodes, binned, edges, grad, hess, np.arange(len(y)), 0, margin)
    if not nodes:
        nodes, roots = [[0, 0.0, 0, 0, 0.0]], [0]
    table = np.array(nodes, dtype=np.float64)
    return Forest(base, np.array(roots), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64),
                  table[:, 3].astype(np.int64), table[:, 4])


def _grow(nodes: list, binned: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray,
          depth: int, margin: np.ndarray) -> int:
    at = len(nodes)
    g, h = grad[rows].sum(), hess[rows].sum()
    value = -RATE * g / (h + L2)
    nodes.append([0, 0.0, at, at, value])
    best = (1e-6, -1, -1)
    if depth < DEPTH and h >= 2 * MIN_HESSIAN:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, weights=grad[rows], minlength=len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, weights=hess[rows], minlength=len(e) + 1))[:-1]
            gain = gl ** 2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g ** 2 / (h + L2)
            gain[(hl < MIN_HESSIAN) | (h - hl < MIN_HESSIAN)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] < 0:
        margin[rows] += value
        return at
    _, f, k = best
    goes_left = binned[rows, f] <= k
    left = _grow(nodes, binned, edges, grad, hess, rows[goes_left], depth + 1, margin)
    right = _grow(nodes, binned, edges, grad, hess, rows[~goes_left], depth + 1, margin)
    nodes[at] = [f, float(edges[f][k]), left, right, 0.0]
    return at


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled rows outside the held-out fold, chosen by
    the hash order of the id. The chosen ids are the broadcast side: their number is the bound."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(chosen), "doc_id")


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tk.arrow_bytes(batch.column("text"))
        for lo, hi in tk.byte_batches(texts):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo),
                 pa.array(list(features(texts[lo:hi])), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Forest:
    """Fit the forest on the bounded sample (feature rows of a bounded number come to the driver)."""
    arrow_rows(docs.sparkSession)
    rows = (training_rows(docs, labels, "quality", bound)
            .mapInArrow(_features_of, "doc_id long, label int, x array<double>").toPandas())
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, forest: Forest, cutoff: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null and empty texts are scored from
    their zero statistics. Rows are scored one by one; other columns are ignored."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.arrow_bytes(batch.column("text"))
            for lo, hi in tk.byte_batches(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo),
                                                  pa.array(forest.probability(features(texts[lo:hi])))],
                                                 names=["doc_id", "score"])

    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))


def accepted(docs: DataFrame, forest: Forest, cutoff: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``cutoff``, with all their columns, whatever their names, in
    one pass. Null and empty texts are scored from their zero statistics."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.arrow_bytes(batch.column("text"))
            keep = [forest.probability(features(texts[lo:hi])) >= cutoff for lo, hi in tk.byte_batches(texts)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, dtype=bool)))

    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")
    told = docs.select(row, F.col("text").cast("string").alias("text"))
    return told.mapInArrow(run, told.schema).select("row.*")
