"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features (and then over chosen pairs
of features) on binned values; each tree only adds to its feature's lookup
table, so a document's score is an intercept plus one table entry a feature and
a pair. The model is fitted on a bounded sample of labelled documents, the ids
with the smallest hashes; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_bucket, hash_sample, lean, raw_texts, sums, Words

#: Labelled documents that the model is fitted on at most, and the shape of the model.
SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_words", "mean_length", "sd_length", "upper_words", "capital_words", "digit_words", "symbol_words", "pipe_words", "bang_words",
    "ended_words", "comma_words", "sentence_length", "symbol_chars", "non_ascii", "distinct_words", "top_word", "dup_lines", "line_length",
    "repeat_windows", "long_words",
)

_SYMBOLS = frozenset(b"#*$%&|<>{}[]=~^_\\@/+")


def _describe(words: list[bytes]) -> dict[str, np.ndarray]:
    """Properties of words that features add up, one row a word."""
    rows = np.zeros((len(words), 12), np.float32)
    for k, w in enumerate(words):
        n = len(w)
        core = w.rstrip(b".,;:!?#*$%&|\"')")
        marks = n - len(w.translate(None, b"#*$%&|<>{}[]=~^_\\@/+"))
        last = w[-1:]
        letters = core.decode("utf-8", "replace")
        rows[k] = (n, n * n, len(letters) > 1 and letters.isupper(), letters[:1].isupper(), any(48 <= c < 58 for c in w), marks > 0, w == b"|", last == b"!", last in (b".", b"?", b"!"), last == b",", marks, n > 20)
    return {"sums": rows, "non_ascii": np.array([sum(c >= 192 for c in w) for w in words], np.float32)}


class Features:
    """The feature matrix of a list of texts; empty texts give zeros."""

    def __init__(self) -> None:
        self.words = Words(_describe, 200_000)

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        lists = [t.split() for t in texts]
        ids, ends = self.words.indices(lists)
        n = np.diff(ends)
        out = np.zeros((len(texts), len(FEATURES)), np.float64)
        if not len(ids):
            return out
        total = sums(self.words.columns["sums"][ids].astype(np.float64), ends)
        accents = sums(self.words.columns["non_ascii"][ids].astype(np.float64), ends)
        d, chars = np.maximum(n, 1), np.maximum(total[:, 0], 1)
        mean = total[:, 0] / d
        out[:, 0] = np.log1p(n)
        out[:, 1] = mean
        out[:, 2] = np.sqrt(np.maximum(total[:, 1] / d - mean**2, 0))
        out[:, 3:8] = total[:, 2:7] / d[:, None]
        out[:, 8:11] = total[:, 7:10] / d[:, None]
        out[:, 11] = n / np.maximum(total[:, 8], 1)
        out[:, 12] = total[:, 10] / chars
        out[:, 13] = accents / chars
        out[:, 19] = total[:, 11] / d
        for k, text in enumerate(texts):
            a, b = ends[k], ends[k + 1]
            if a == b:
                continue
            counts = np.unique(ids[a:b], return_counts=True)[1]
            out[k, 14], out[k, 15] = len(counts) / (b - a), counts.max() / (b - a)
            lines = [x for x in text.split(b"\n") if x.strip()]
            out[k, 16], out[k, 17] = 1 - len(set(lines)) / len(lines), len(text) / len(lines)
            if b - a > 3:
                w = ids[a:b].astype(np.uint64)
                h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
                out[k, 18] = 1 - len(np.unique(h)) / len(h)
        return out


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins [lo, hi) by Newton gain, left part [lo, cut)."""
    if hi - lo < 2:
        return 0.0, lo
    cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    tg, th = g[lo:hi].sum(), h[lo:hi].sum()
    gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values by bin of a tree of at most `leaves` leaves on one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g, h, a, b), a, b) for a, b in parts), key=lambda s: s[0])
        if best[0] <= 1e-9:
            break
        parts.remove((best[2], best[3]))
        parts += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quads(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis of a grid: its gain and its values."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.ix_(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]))
    if not a.size or not b.size:
        return 0.0, np.zeros_like(g)
    parts = lambda c: (c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b])
    gain = sum(x**2 / (y + 1) for x, y in zip(parts(cg), parts(ch), strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: all features in turn, then the pairs with the largest gain on what is left.

    Without rows, or with one class, the tables stay empty and the score is the base rate.
    """
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    f = x.shape[1]
    edges = [_edges(x[:, k], BINS) for k in range(f)]
    pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(f)]
    model = AdditiveModel(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], [], pair_edges, [])
    if not len(y) or len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(edges[k], x[:, k], "right") for k in range(f)]
    logit = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(f):
            g, h = gradients()
            size = len(edges[k]) + 1
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            logit += step[bins[k]]
    coarse = [np.searchsorted(pair_edges[k], x[:, k], "right") for k in range(f)]
    side = [len(e) + 1 for e in pair_edges]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * side[j] + coarse[j], values, side[i] * side[j]).reshape(side[i], side[j])

    g, h = gradients()
    gains = sorted(((_quads(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(f) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j) for gain, i, j in gains if gain > 0]
    model.pair_tables = [np.zeros((side[i], side[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradients()
            step = RATE * _quads(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            logit += step[coarse[i], coarse[j]]
    return model


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Fits on at most `sample` labelled rows whose id's crc32 mod 5 is not 0.

    Ids with several labels count by their mean; null ids and labels teach nothing; of rows
    with a chosen id at most `sample` count, those with the smallest hashes, equal rows
    once. Null texts are texts without words. Without rows of both labels every score is the share of label 1.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (doc_bucket("doc_id", 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in chunks(batches):
            rows = features.matrix(raw_texts(batch)).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["y", "x"])

    labelled = hash_sample(_texts(docs, doc_id, text).join(F.broadcast(chosen), "doc_id"), sample)
    rows = labelled.select("text", "y").mapInArrow(lean(featured), "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f8").reshape(-1, len(FEATURES))
    y = np.array(rows["y"].to_pylist(), float)
    order = np.lexsort((*x.T[::-1], y))  # tasks end in any order
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Null and empty texts score as texts without words."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in chunks(batches):
            score = model.score(features.matrix(raw_texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = _texts(docs, doc_id, text).mapInArrow(lean(scored), "doc_id long, score double, predicted int")
    return out.select("doc_id", (doc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
