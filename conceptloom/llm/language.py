"""Language identification by the nearest of several centroids a language.

A text's vector counts n-grams of letters (1 to 3, within words and their bounds)
hashed to DIMENSIONS places, dampened by a logarithm, weighted by inverse
document frequency and normalised. Each language's sample is clustered by
spherical k-means; the language of the centroid with the largest cosine wins.
A text farther from it than its cluster's own texts are is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_bucket, hash_sample, lean, raw_texts, Words, written

DIMENSIONS = 4096
#: Documents a language that the centroids are fitted on at most, and centroids a language.
SAMPLE_PER_LANGUAGE, CENTROIDS, STEPS = 400, 4, 12
#: Texts rarer among their own cluster than this quantile are rejected.
REJECT_QUANTILE = 0.005
_PIECE = 64


class Grams:
    """Dense count vectors of texts."""

    def __init__(self) -> None:
        self.words = Words(self._describe, 200_000)
        self.grams = np.zeros(0, np.int32)
        self.used = 0

    def _describe(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """Hashed n-grams of the letters of new words, kept one after the other."""
        if not self.words.filled:
            self.used = 0
        texts = [f"\x02{''.join(filter(str.isalpha, w.decode('utf-8', 'replace').lower()))}\x03" for w in words]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        place = np.arange(len(codes))
        left = np.repeat(ends, sizes) - place  # symbols of the word from here on
        head = np.zeros(len(codes), bool)
        head[starts] = True
        all_grams, all_at = [], []
        for n in (1, 2, 3):
            ok = left >= n
            if n == 1:
                ok &= (left > 1) & ~head  # bounds alone say nothing
            at = place[ok]
            h = np.full(len(at), n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
            for k in range(n):
                h = (h ^ codes[at + k]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            all_grams.append((h % np.uint64(DIMENSIONS)).astype(np.int32))
            all_at.append(at)
        grams, at = np.concatenate(all_grams), np.concatenate(all_at)
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
        word = np.searchsorted(ends, at, "right")
        count = np.bincount(word, minlength=len(words)).astype(np.int64)
        first = self.used + np.cumsum(count) - count
        need = self.used + len(grams)
        if need > len(self.grams):
            grown = np.zeros(2 * need, np.int32)
            grown[: self.used] = self.grams[: self.used]
            self.grams = grown
        self.grams[self.used : need] = grams
        self.used = need
        letter = (sizes > 2).astype(np.int64)
        return {"first": first, "count": count, "letter": letter}

    def vectors(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, counts, has a letter) of each text."""
        ids, ends = self.words.indices([t.split() for t in texts])
        for k in range(len(texts)):
            mine = ids[ends[k] : ends[k + 1]]
            if not len(mine):
                yield k, np.zeros(DIMENSIONS), False
                continue
            first, count = self.words.columns["first"][mine], self.words.columns["count"][mine]
            jump = np.repeat(first - np.cumsum(count) + count, count)
            grams = self.grams[jump + np.arange(len(jump))]
            yield k, np.bincount(grams, minlength=DIMENSIONS).astype(np.float64), bool(self.words.columns["letter"][mine].any())


def _unit(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows; centroids and the cosine below which a row is rejected."""
    picks = [0]
    near = x @ x[0]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    centroids = x[picks]
    for _ in range(STEPS):
        own = np.argmax(x @ centroids.T, axis=1)
        centroids = np.array([x[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    cosine = x @ centroids.T
    own = np.argmax(cosine, axis=1)
    cut = np.array([np.quantile(cosine[own == c, c], REJECT_QUANTILE) if (own == c).any() else 0.0 for c in range(len(centroids))])
    return centroids, cut


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language of each centroid, centroids, cuts and idf.

    Learns from rows with a language and a text and crc32(id) mod 4 other than 2: of each
    language the `per_language` rows with the smallest hashes, equal rows once. Each task
    keeps so many hashes, so a language that holds most rows is not one task's. Texts
    without a letter teach nothing; an empty table gives no language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (doc_bucket(doc_id, 4) != 2))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in chunks(batches):
            out = [(k, v) for k, v, letter in grams.vectors(raw_texts(batch)) if letter]
            keep = pa.array([k for k, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array([v.astype("<f4").tobytes() for _, v in out], pa.binary())], names=["lang", "h", "x"])

    # a row a sampled document, at most per_language a language
    sample = hash_sample(rows, per_language, "lang").select("lang", "h", "text")
    sample = written(sample.mapInArrow(lean(vectors), "lang string, h long, x binary"), "language-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, "<f4") > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "df"])

    parts = sample.select("x").coalesce(8).mapInArrow(lean(frequencies), "n long, df binary").collect()
    n, df = sum(r["n"] for r in parts), sum((np.frombuffer(r["df"]) for r in parts), np.zeros(DIMENSIONS))
    idf = np.log((1 + n) / (1 + df)) + 1

    def clustered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "x"])
        x = _unit(np.stack([np.frombuffer(b, "<f4") for b in frame["x"]]).astype(float), idf)
        centroids, cut = cluster(x)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "c": range(len(cut)), "cut": cut, "x": [c.tobytes() for c in centroids]})

    got = sorted(sample.groupBy("lang").applyInPandas(clustered, "lang string, c int, cut double, x binary").collect(), key=lambda r: (r["lang"], r["c"]))
    centroids = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, DIMENSIONS)
    return [r["lang"] for r in got], centroids, np.array([r["cut"] for r in got]), idf


def identify(docs: DataFrame, model: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine) and rejected of every document.

    `und` with score 0 if a text is null or has no letter, or no language was learned. Of equal
    cosines the first centroid wins, in order of language. Repeated rows are predicted each; other columns are ignored.
    """
    names, centroids, cut, idf = model

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in chunks(batches):
            n = batch.num_rows
            best, score, far = ["und"] * n, np.zeros(n), np.ones(n, bool)
            held: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                cosine = _unit(np.array([v for _, v in held]), idf) @ centroids.T
                for (k, _), row in zip(held, cosine, strict=True):
                    c = int(np.argmax(row))
                    best[k], score[k], far[k] = names[c], min(1.0, max(0.0, row[c])), row[c] < cut[c]
                held.clear()

            for k, v, letter in grams.vectors(raw_texts(batch)):
                if letter and names:
                    held.append((k, v))
                if len(held) == 512:
                    settle()
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lean(predicted), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (doc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
