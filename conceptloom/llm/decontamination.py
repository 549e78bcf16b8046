"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words, weighted by TF-IDF over hashed terms and projected
to a latent space that a randomised decomposition of all documents gives. Each
benchmark item is held against all windows of about its own length. The longest
common subsequence of words covers most of a verbatim copy. A paraphrase has
less of it: the candidate search must find it, so a window of the region, as long as
the item and beginning at any word, must have a cosine to the item of at least COSINE,
and the item's answer (its answer column, else its last words) must be there.

Neither kind is looked for where it can't be: a match lacks at most a share of the
item's words, so of its rarest words a region must hold a certain number. This
leaves out no match, whatever its cosine.

Document frequencies cover all documents, and the latent space all documents and items: one
pass counts and multiplies their terms with a random matrix, of which the leading
directions follow (Nystrom's method).
Benchmark items are the query set: they go out in blocks of ITEM_BLOCK, each of
which meets all windows of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import CHUNK_BYTES, chunks, lean, raw_texts, sums, word_hashes, Words, written

TERMS, RANK, EXTRA = 8192, 64, 8
ITEM_BLOCK = 4096
VERBATIM, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.8, 0.6, 0.75, 8
#: The cosine that the window of a paraphrase has to its item.
COSINE = 0.4
#: Words a block; windows begin and end at blocks.
STEP = 4
#: Bins of word hashes whose shares of all words tell which words are rare.
RATE_BINS = 1 << 15
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def _bare(words: list[bytes]) -> list[bytes]:
    """Words without marks, in lower case; one of marks alone is left as it is."""
    return [w.lower().translate(None, _MARKS) or w for w in words]


def _describe(words: list[bytes]) -> dict[str, np.ndarray]:
    h = word_hashes(_bare(words))
    return {"h": h, "term": ((h >> np.uint64(20)) % np.uint64(TERMS)).astype(np.int32)}


def _bin(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(RATE_BINS)).astype(np.int64)


#: Parts of the product that tasks send to be added up, and texts multiplied at once.
_PARTS, _AT_ONCE = 64, 256
#: Bytes of text counted together where executors are already full of what came before; it takes longer.
FEW_BYTES = 1 << 20


def _random_terms() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((TERMS, RANK + EXTRA)).astype(np.float32)


@dataclass
class Statistics:
    """Of each hashed term the number of documents that have it; documents; of each bin of hashes its share of all words; the product of _latent."""

    df: np.ndarray
    documents: int
    rates: np.ndarray
    product: np.ndarray


def statistics(docs: DataFrame, items: DataFrame, text: str = "text", most: int = CHUNK_BYTES) -> Statistics:
    """Counts over all documents, and the product C'C x over all documents and items, in one pass.

    A row of C has a text's distinct terms, divided by the root of their number; x is random.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = Words(lambda new: (x := _describe(new)) | {"bin": _bin(x["h"])}), np.zeros(TERMS + 1 + RATE_BINS, np.int64)
        x = _random_terms()
        product = np.zeros_like(x)
        for batch in chunks(batches, most=most):
            ids, ends = table.indices([t.lower().split() for t in raw_texts(batch)])
            own = np.asarray(batch.column(1))
            total[TERMS] += own.sum()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            if len(ids):
                term = table.columns["term"][ids]
                total[TERMS + 1 :] += np.bincount(table.columns["bin"][ids[own[row]]], minlength=RATE_BINS)
            for a in range(0, batch.num_rows if len(ids) else 0, _AT_ONCE):
                b = min(batch.num_rows, a + _AT_ONCE)
                seen = np.zeros((b - a, TERMS), np.float32)
                seen[row[ends[a] : ends[b]] - a, term[ends[a] : ends[b]]] = 1
                total[:TERMS] += (own[a:b].astype(np.float32) @ seen).astype(np.int64)
                product += seen.T @ (seen @ x / np.maximum(seen.sum(axis=1, keepdims=True), 1))
        at = np.flatnonzero(total)
        parts = [p.tobytes() for p in np.split(product, _PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(_PARTS), *[None] * len(at)], pa.int32()), pa.array(parts + [None] * len(at), pa.binary()), pa.array([None] * _PARTS + at.tolist(), pa.int64()), pa.array([0] * _PARTS + total[at].tolist(), pa.int64())], names=["part", "product", "term", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[part] = held.get(part, 0.0) + np.frombuffer(raw, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "product"])

    rows = docs.select(F.col(text).alias("text"), F.lit(True).alias("own")).unionByName(items.select("text", F.lit(False).alias("own")))
    rows = written(rows.mapInArrow(lean(counted), "part int, product binary, term long, n long"), "statistics")
    counts = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 1 + RATE_BINS rows at most
    total, product = np.zeros(TERMS + 1 + RATE_BINS, np.int64), np.zeros((TERMS, RANK + EXTRA))
    total[counts["term"].to_numpy()] = counts["n"].to_numpy()
    sums_ = rows.where("part is not null").select("part", "product").repartition("part").mapInArrow(lean(added), "part int, product binary").toArrow()  # _PARTS rows
    size = TERMS // _PARTS
    for part, raw in zip(sums_["part"].to_pylist(), sums_["product"].to_pylist(), strict=True):
        product[part * size : (part + 1) * size] = np.frombuffer(raw, np.float64).reshape(size, -1)
    return Statistics(total[:TERMS], int(total[TERMS]), total[TERMS + 1 :] / max(1, total[TERMS + 1 :].sum()), product)


def latent(product: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (TERMS x RANK at most) of C with its columns weighted by idf, from C'C x for a random x.

    With D the weights and K = D C'C D, K (x / idf) = D C'C x, so the weights need not be known when texts are read.
    """
    value, vector = np.linalg.eigh(_random_terms().astype(np.float64).T @ product)
    some = value > 1e-9 * max(1e-9, value[-1])
    half = idf[:, None] * product @ (vector[:, some] / np.sqrt(value[some]))
    return np.linalg.svd(half, full_matrices=False)[0][:, :RANK].astype(np.float32)


@dataclass
class Queries:
    """A block of benchmark items, their words coded by place in `vocabulary`."""

    item_ids: list
    words: list[np.ndarray]  # codes
    answers: list[np.ndarray]  # codes
    vectors: np.ndarray
    vocabulary: np.ndarray  # hashes of all words of items and answers, in order; any other word is one beyond
    forms: dict[bytes, int]  # the words of items and answers, without marks, and their codes
    rare: list[np.ndarray]  # of each item the codes of its rarest words, each once
    least: np.ndarray  # of each item how many occurrences of its rarest words a matching region has
    weights: np.ndarray  # of each term its latent vector times its idf

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)

    def table(self) -> dict[bytes, int]:
        """The codes of words, without marks."""
        return self.forms


def window_length(words: int) -> int:
    """The window for an item, from a geometric series of lengths."""
    length = 2 * STEP
    while length * 1.15 < words:
        length = max(length + STEP, int(length * 1.3) // STEP * STEP)
    return length // STEP


def _rarest(own: np.ndarray, rate: np.ndarray, span: int) -> tuple[np.ndarray, int]:
    """Places of an item's rarest words and how many of these a match has, so chosen that chance seldom brings as many.

    A match lacks at most a share of the item's words, so of any n words it has all but that number.
    """
    order = np.argsort(rate, kind="stable")
    lacking = int(np.floor((1 - PARAPHRASE) * len(own) + 1e-9))
    best = None
    for n in range(lacking + 1, len(own) + 1):
        mean, least = span * rate[order[:n]].sum() + 1e-9, n - lacking
        # Chernoff's bound of a Poisson number that reaches `least`
        tail = 0.0 if mean >= least else least - mean - least * np.log(least / mean)
        if best is None or tail < best[0]:
            best = tail, n, least
    return order[: best[1]], best[2]


def prepare_queries(rows: list, weights: np.ndarray, idf: np.ndarray, rates: np.ndarray | None = None) -> Queries:
    """rows: (item_id, text, answer or None); items without a word match nothing. rates: of each bin of word hashes its share of all words."""
    table = Words(_describe)
    rows = [r for r in rows if r[1] and r[1].split()]
    ids, ends = table.indices([r[1].encode().split() for r in rows])
    h = table.columns["h"][ids] if rows else np.zeros(0, np.uint64)
    term = table.columns["term"][ids] if rows else np.zeros(0, np.int32)
    rates = np.full(RATE_BINS, 1e-3) if rates is None else rates
    vectors = sums(weights[term].astype(np.float64), ends)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    answers = [(r[2] or "").encode().split() for r in rows]
    given = [_describe(a)["h"] for a in answers]
    out = Queries([r[0] for r in rows], [], [], vectors, np.unique(np.concatenate([h, *given])), {}, [], np.zeros(len(rows), np.int64), weights)
    forms = list(dict.fromkeys(_bare([*table, *chain.from_iterable(answers)])))
    out.forms.update(zip(forms, out.coded(word_hashes(forms)).tolist(), strict=True))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        own = out.coded(h[a:b])
        out.words.append(own)
        out.answers.append(out.coded(given[k]) if len(given[k]) else own[-ANSWER_WORDS:])
        places, out.least[k] = _rarest(own, rates[_bin(h[a:b])], _region(window_length(b - a)))
        out.rare.append(np.unique(own[places]))
    return out


def _region(length: int) -> int:
    """Words that are compared for a window of so many blocks."""
    return (length + 2 * (length // 2 + 1)) * STEP


def common_subsequences(pattern: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Length of the longest common subsequence of a pattern and of each codes[low:high]; codes are below `size`.

    A bit a pattern word, in as many 64-bit words as it takes, all regions at once.
    """
    limbs = -(-len(pattern) // 64)
    masks = np.zeros((limbs, size), np.uint64)
    for k, c in enumerate(pattern.tolist()):
        masks[k // 64, c] |= np.uint64(1 << k % 64)
    order = np.argsort(low - high, kind="stable")
    at, n = low[order], (high - low)[order]
    some = masks.any(axis=0)
    v = np.full((limbs, len(at)), ~np.uint64(0), np.uint64)
    open_ends = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), "right")
    for t, many in enumerate(open_ends.tolist()):
        c = codes[at[:many] + t]
        hit = np.flatnonzero(some[c])
        if not len(hit):
            continue
        c = c[hit]
        carry = None
        for limb in range(limbs):
            old = v[limb, hit]
            u = old & masks[limb][c]
            total = old + u
            over = total < old
            if carry is not None:
                total = total + carry
                over |= (carry == 1) & (total == 0)
            carry = over.astype(np.uint64) if limb + 1 < limbs else None
            v[limb, hit] = total | (old - u)
    full = [~np.uint64(0)] * (limbs - 1) + [np.uint64((1 << (len(pattern) - 1) % 64 + 1) - 1)]
    out = np.zeros(len(at), np.int64)
    out[order] = len(pattern) - sum(np.bitwise_count(v[k] & full[k]).astype(np.int64) for k in range(limbs))
    return out


def _holding(pattern: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which codes[low:high] have `least` of the pattern's words at any places; a common subsequence is no longer than what they have."""
    own, many = np.unique(pattern, return_counts=True)
    place = np.full(size, -1, np.int32)
    place[own] = np.arange(len(own))
    n = high - low
    at = place[codes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]]
    region = np.repeat(np.arange(len(n)), n)[at >= 0]
    found = np.bincount(region * len(own) + at[at >= 0], minlength=len(n) * len(own)).reshape(len(n), -1)
    return np.flatnonzero(np.minimum(found, many).sum(axis=1) >= least - 1e-6)


def _windows(p: np.ndarray, least: int, length: int, row: np.ndarray, inside: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, low block, high block) of the regions of windows that hold `least` of the places p or more, and a few others.

    p: sorted places of rare words, texts lying a region apart; row and inside: text and place in the text of each.
    """
    near = np.flatnonzero(p[least - 1 :] - p[: len(p) - least + 1] < _region(length))
    stride, margin = max(1, length // 3), length // 2 + 1
    a, b, r = inside[near] // STEP, inside[near + least - 1] // STEP, row[near]
    many = -(-np.maximum(blocks[r] - length, 0) // stride) + 1
    first = np.clip(-(-(b - length - margin + 1) // stride), 0, many - 1)
    last = np.clip((a + margin) // stride + 1, first, many - 1)
    n = last - first + 1
    widest = int(many.max()) if len(many) else 1
    k = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    key = np.unique(np.repeat(r, n) * widest + k)
    r, k = key // widest, key % widest
    start = np.minimum(k * stride, np.maximum(blocks[r] - length, 0))
    return r, np.maximum(start - margin, 0), np.minimum(np.minimum(start + length, blocks[r]) + margin, blocks[r])


def _coded(words: list[bytes], table: dict[bytes, int], other: int) -> np.ndarray:
    """Codes of lower-case words; most are in the table as they are or, without a mark, not in it at all."""
    code = np.fromiter(map(table.get, words, repeat(other)), np.int32, len(words))
    unknown = np.flatnonzero(code == other)
    plain = np.fromiter(map(bytes.isalnum, map(words.__getitem__, unknown.tolist())), bool, len(unknown))
    marked = unknown[~plain]
    if len(marked):
        bare = b"\n".join(map(words.__getitem__, marked.tolist())).translate(None, _MARKS).split(b"\n")
        code[marked] = np.fromiter(map(table.get, bare, repeat(other)), np.int32, len(marked))
    return code


def find(queries: Queries, table: dict[bytes, int], texts: list[bytes]) -> list[tuple[int, int, float, float]]:
    """(row, item number, share of the item in the common subsequence, cosine) of verified matches.

    table: from queries.table().
    """
    lists = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    if not ends[-1] or not queries.words:
        return []
    words = list(chain.from_iterable(lists))
    code = _coded(words, table, len(queries.vocabulary))
    blocks = -(-n // STEP)
    size = len(queries.vocabulary) + 1
    # places of rare words by code; texts lie so far apart that no region reaches from one to another
    scarce = np.zeros(size, bool)
    scarce[np.concatenate(queries.rare)] = True
    place = np.flatnonzero(scarce[code])
    of = np.repeat(np.arange(len(n)), n)[place]
    order = np.argsort(code[place], kind="stable")
    bounds = np.searchsorted(code[place][order], np.arange(size + 1))
    gap = max(_region(window_length(len(w))) for w in queries.words)
    apart = (place + of * gap)[order]
    found: list[tuple[int, int, float, float]] = []
    for item, pattern in enumerate(queries.words):
        rare, least = queries.rare[item], int(queries.least[item])
        p = [apart[bounds[c] : bounds[c + 1]] for c in rare.tolist()]
        if sum(map(len, p)) < least:
            continue
        p = np.sort(np.concatenate(p))
        length = window_length(len(pattern))
        if not (p[least - 1 :] - p[: len(p) - least + 1] < _region(length)).any():
            continue
        # texts are apart by `gap`, so the text of a place follows from where texts begin
        row = np.searchsorted(ends[:-1] + np.arange(len(n)) * gap, p, "right") - 1
        row, low, high = _windows(p, least, length, row, p - row * gap - ends[row], blocks)
        low, high = ends[row] + low * STEP, np.minimum(ends[row] + high * STEP, ends[row + 1])
        share = np.zeros(len(low))
        some = _holding(pattern, code, low, high, size, PARAPHRASE * len(pattern))
        share[some] = common_subsequences(pattern, code, low[some], high[some], size) / len(pattern)
        ok = np.flatnonzero(share >= PARAPHRASE)
        done = set()
        for w in ok[np.argsort(-share[ok], kind="stable")].tolist():
            r = int(row[w])
            if r in done:
                continue
            cosine = _nearest(queries, item, _describe(words[low[w] : high[w]])["term"])
            if share[w] < VERBATIM:
                answer = queries.answers[item]
                if cosine < COSINE or common_subsequences(answer, code, low[w : w + 1], high[w : w + 1], size)[0] < ANSWER * len(answer):
                    continue
            done.add(r)
            found.append((r, item, float(share[w]), cosine))
    return found


def _nearest(queries: Queries, item: int, terms: np.ndarray) -> float:
    """The greatest cosine of an item and of a region's windows; one of the item's length begins at every word."""
    n, size = len(terms), len(queries.words[item])
    start = np.arange(max(1, n - size + 1))
    total = np.concatenate([np.zeros((1, queries.weights.shape[1])), np.cumsum(queries.weights[terms], axis=0, dtype=np.float64)])
    x = total[np.minimum(start + size, n)] - total[start]
    return float((x @ queries.vectors[item] / np.maximum(np.linalg.norm(x, axis=1), 1e-12)).max())


def query_blocks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = CHUNK_BYTES) -> Iterator[Queries]:
    """The benchmark's items in blocks, each ready to be sent to all tasks. Items that are the same are one; an item_id may be of any type."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", answer.alias("answer")).distinct()
    n = items.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    items = items.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    known = statistics(docs, items, text, most)
    idf = np.log((1 + known.documents) / (1 + known.df)) + 0.1
    weights = latent(known.product, idf) * idf[:, None].astype(np.float32)
    for b in range(blocks):
        yield prepare_queries([(r["item_id"], r["text"], r["answer"]) for r in items.where(F.col("b") == b).collect()], weights, idf, known.rates)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, share, cosine, kind of every (document, benchmark item) pair that matches.

    Null or empty texts and items match nothing; an empty benchmark or table gives no
    rows. A repeated row of docs matches again; repeated items count once.
    Of windows with equal shares the first one's cosine is told. Texts of any
    length are searched whole. Other columns are ignored.
    """
    rows, out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), None
    kind = benchmark.schema["item_id"].dataType
    held_as = to_arrow_type(kind)
    for queries in query_blocks(docs, benchmark, doc_id, text):
        held = docs.sparkSession.sparkContext.broadcast(queries)

        def matched(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value.table()
            for batch in chunks(batches, most=2 << 20):
                found = find(held.value, table, raw_texts(batch))
                if found:
                    row, item, share, cosine = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([held.value.item_ids[k] for k in item], held_as), pa.array(share), pa.array(cosine)], names=["doc_id", "item_id", "share", "cosine"])

        part = rows.mapInArrow(lean(matched), StructType([StructField("doc_id", LongType()), StructField("item_id", kind), StructField("share", DoubleType()), StructField("cosine", DoubleType())]))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("kind", F.when(F.col("share") >= VERBATIM, "verbatim").otherwise("paraphrase"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that match no benchmark item.

    Null and empty texts match nothing and stay; every repeated row is judged as it
    stands; an empty table or benchmark drops nothing. No column name is taken.
    """
    out = docs
    for queries in query_blocks(docs, benchmark, most=FEW_BYTES):
        held = docs.sparkSession.sparkContext.broadcast(queries)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value.table()
            for batch in chunks(batches, most=2 << 20):
                hit = {r for r, *_ in find(held.value, table, raw_texts(batch))}
                yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in hit], pa.int64()))

        out = out.mapInArrow(lean(clean), docs.schema)
    return out
