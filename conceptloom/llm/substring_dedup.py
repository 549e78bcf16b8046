"""Substring deduplication with a log-structured fingerprint index.

A window of WINDOW words has as its fingerprint the smallest hash among the
GRAM-word runs inside it (leftmost if equal), so equal windows have equal
fingerprints, and neighbouring windows mostly share one. The index holds
fingerprints with their numbers of places in sorted immutable runs. A new batch's
run is merge-joined with the runs of the past; fingerprints with two places or
more are candidates. Runs are compacted into one when there are many.

Candidates are verified on whole windows: a second look at the texts takes the
hashes (96 bits) of all windows with a candidate fingerprint, and those that start
in two places are repeats. An index that is kept for later calls also keeps the window hashes
of the past, in sorted runs of their own, so that a passage that stands in the past and once
in a new call is verified and removed as well. Repeats within one chunk of text are settled there, and
one row a chunk stands for them, so a passage that a third of all documents
share is never one task's burden. Words that a repeated window covers are
removed, all at once; what is left is not judged again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, IdFilter, lean, mix, raw_texts, shared_dir, word_hashes, Words, written

WINDOW, GRAM = 35, 12
BATCHES, MAX_RUNS = 4, 2
#: Text that is looked at together; a worker holds some forty bytes of arrays a byte of text.
CHUNK_BYTES = 2 << 20
_BASE, _CHECK = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_PLACE = np.uint64((1 << 24) - 1)
#: Flag of a window of the past: it makes others repeats and is none of theirs.
_PAST = 3


class Rolling:
    """Hashes of all runs of words at once, by prefix sums of h[j] B^j modulo 2^64 (B is odd, so powers can be undone)."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        self.inverse = inverse
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])])

    def runs(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


class Chunk:
    """A chunk of texts: for each window its start (among all words), fingerprint and place in its text."""

    def __init__(self, table: Words, texts: list[bytes], window: int, gram: int):
        self.window = window
        ids, self.ends = table.indices([t.split() for t in texts])
        self.hashes = table.columns["h"][ids] if len(ids) else np.zeros(0, np.uint64)
        n = np.diff(self.ends)
        many = np.maximum(n - window + 1, 0)
        self.row = np.repeat(np.arange(len(n)), many)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(many) - many, many)
        self.start = self.ends[self.row] + self.place
        if not len(self.row):
            self.anchor, self.fingerprint = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        self.rolling = Rolling(self.hashes, _BASE)
        grams = self.rolling.runs(gram)
        # the smallest of the grams in each window, by doubling; its place is in the low bits
        low = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64) & _PLACE
        width, left = 1, window - gram + 1
        while 2 * width <= left:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        shift = left - width
        low = np.minimum(low[: len(low) - shift], low[shift:]) if shift else low
        base = self.start & ~np.int64(int(_PLACE))
        anchor = base | (low[self.start] & _PLACE).astype(np.int64)
        self.anchor = np.where(anchor < self.start, anchor + int(_PLACE) + 1, anchor)
        self.fingerprint = grams[self.anchor]

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows at these places."""
        check = Rolling(mix(self.hashes + np.uint64(1)), _CHECK).runs(self.window)[self.start[at]]
        return self.rolling.runs(self.window)[self.start[at]], (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _words() -> Words:
    return Words(lambda new: {"h": word_hashes(new)})


class FingerprintIndex:
    """Sorted immutable runs of fingerprints under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, max_runs: int = MAX_RUNS):
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.path = path or f"{shared_dir(spark)}/conceptloom/index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.windows: list[str] = []

    def remember(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a run of all window hashes of docs, with their fingerprints, for calls to come."""
        window, gram = self.window, self.gram

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _words()
            for batch in chunks(batches, most=CHUNK_BYTES):
                part = Chunk(table, raw_texts(batch), window, gram)
                if len(part.row):
                    whole, check = part.whole(np.arange(len(part.row)))
                    yield pa.RecordBatch.from_arrays([pa.array(part.fingerprint.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(check)], names=["fp", "r", "check"])

        path = f"{self.path}/windows-{uuid.uuid4().hex}"
        rows = docs.select(F.col(text).alias("text")).mapInArrow(lean(hashed), "fp long, r long, check int").distinct()
        rows.repartition("fp").sortWithinPartitions("fp").write.parquet(path)
        self.windows.append(path)

    def past(self) -> DataFrame | None:
        """fp, r, check of all windows of the past, if any are kept."""
        return self.spark.read.schema("fp long, r long, check int").parquet(*self.windows) if self.windows else None

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("fp").write.parquet(path)  # grouped by fp: dealt by its hash, sorted in each part
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("fp long, n long").parquet(path)

    def ingest(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds a batch as a run. Returns the batch's fingerprints that have another place, in the batch or in the past."""
        window, gram = self.window, self.gram

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _words()
            for batch in chunks(batches, most=CHUNK_BYTES):
                part = Chunk(table, raw_texts(batch), window, gram)
                places = np.unique(part.anchor, return_index=True)[1]
                if len(places):
                    found, n = np.unique(part.fingerprint[places], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["fp", "n"])

        counts = docs.select(F.col(text).alias("text")).mapInArrow(lean(counted), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
        past = [self._read(p).select("fp") for p in self.runs]
        self.runs.append(self._write(counts))
        new = self._read(self.runs[-1])
        hits = new.where("n > 1").select("fp")
        for run in past:
            hits = hits.unionByName(new.join(run.hint("merge"), "fp", "left_semi").select("fp"))
        if len(self.runs) > self.max_runs:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merges all runs into one. Old runs stay on disk for readers that began before."""
        rows = self._read(self.runs[0])
        for path in self.runs[1:]:
            rows = rows.unionByName(self._read(path))
        self.runs = [self._write(rows.groupBy("fp").agg(F.sum("n").alias("n")))]

    def fingerprints(self) -> DataFrame:
        """fp, n over all runs."""
        rows = self._read(self.runs[0])
        for path in self.runs[1:]:
            rows = rows.unionByName(self._read(path))
        return rows.groupBy("fp").agg(F.sum("n").alias("n"))


def repeats(docs: DataFrame, candidates: DataFrame, window: int = WINDOW, gram: int = GRAM, past: DataFrame | None = None) -> DataFrame:
    """key, spans: of each text (docs: key, text) the merged word spans [a, b) that repeated windows cover, each as a * 2^32 + b.

    past: fp, r, check of windows that stand elsewhere.
    """
    known = IdFilter(candidates, "fp", raw=True)
    bits, held = known.bits, known.words

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _words()
        for batch in chunks(batches, most=CHUNK_BYTES):
            part = Chunk(table, raw_texts(batch), window, gram)
            if not len(part.row):
                continue
            key = batch.column(0).to_numpy()
            b = (part.fingerprint & np.uint64(bits - 1)).astype(np.int64)
            at = np.flatnonzero((held.value[b >> 6] >> (b & 63)) & 1 == 1)
            if not len(at):
                continue
            whole, check = part.whole(at)
            order = np.lexsort((check, whole))
            new = np.ones(len(at), bool)
            new[1:] = (whole[order][1:] != whole[order][:-1]) | (check[order][1:] != check[order][:-1])
            group = np.cumsum(new) - 1
            twice = np.bincount(group)[group] > 1
            local = np.zeros(len(at), bool)
            local[order] = twice
            lone = np.zeros(len(at), bool)
            lone[order] = new
            # a window that starts twice here is settled; one of its rows tells other chunks
            k = np.flatnonzero(local)
            row, place = part.row[at[k]], part.place[at[k]]
            edge = np.ones(len(k) + 1, bool)
            edge[1:-1] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)
            a, z = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
            if len(k):
                own = key[row[a]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(a), np.int32)), pa.array(own), pa.array(place[a]), pa.array(place[z] + window), pa.array(np.full(len(a), 2, np.int8))], names=["r", "check", "key", "a", "b", "flag"])
            k = np.flatnonzero(lone)
            place = part.place[at[k]]
            yield pa.RecordBatch.from_arrays([pa.array(whole[k].view(np.int64)), pa.array(check[k]), pa.array(key[part.row[at[k]]]), pa.array(place), pa.array(place + window), pa.array(local[k].astype(np.int8))], names=["r", "check", "key", "a", "b", "flag"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal windows; a run of two rows, or with a row that stands for two, is a repeat."""
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            r, c = table["r"].to_numpy(), table["check"].to_numpy()
            change = np.flatnonzero((r[1:] != r[:-1]) | (c[1:] != c[:-1])) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from _repeated(table.slice(0, cut))
            carry = table.slice(cut)
            if carry.num_rows > 100_000:  # a run that is long already is a repeat: its rows can go, one stays for the rest
                yield from _repeated(carry)
                carry = carry.slice(0, 1).set_column(5, "flag", pa.array([1], pa.int8()))
        if carry is not None and carry.num_rows:
            yield from _repeated(carry)

    rows = docs.select("key", "text").mapInArrow(lean(windows), "r long, check int, key long, a long, b long, flag byte")
    if past is not None:
        nowhere = [F.lit(0).cast("long").alias(c) for c in ("key", "a", "b")]
        rows = rows.unionByName(known.keep(past, "fp").select("r", "check", *nowhere, F.lit(_PAST).cast("byte").alias("flag")))
    spans = rows.repartition("r").sortWithinPartitions("r", "check").mapInArrow(lean(settled), "key long, a long, b long")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _merge(table.slice(0, cut))
            carry = table.slice(cut)
        if carry is not None and carry.num_rows:
            yield _merge(carry)

    return written(spans.repartition("key").sortWithinPartitions("key", "a").mapInArrow(lean(merged), "key long, spans array<long>"), "spans")


def _repeated(table: pa.Table) -> list[pa.RecordBatch]:
    r, c, flag = table["r"].to_numpy(), table["check"].to_numpy(), table["flag"].to_numpy()
    mark = flag == 2
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    weight = np.bincount(group, np.where(mark, 0, np.where(flag == _PAST, 2, 1 + flag)))
    keep = np.flatnonzero(mark | ((weight[group] > 1) & (flag == 0)))
    return table.select(["key", "a", "b"]).take(pa.array(keep)).to_batches() if len(keep) else []


def _merge(table: pa.Table) -> pa.RecordBatch:
    """Spans of whole keys, sorted by key and start, merged where they touch."""
    key, a, b = (table[c].to_numpy() for c in ("key", "a", "b"))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    rank = np.cumsum(new_key) - 1
    reach = np.maximum.accumulate((rank << 36) + b) - (rank << 36)
    new = new_key.copy()
    new[1:] |= a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(key) - 1)
    spans = (a[first] << 32) + reach[last]
    firsts = np.searchsorted(first, np.flatnonzero(new_key))
    offsets = np.append(firsts, len(first)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key[new_key]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans))], names=["key", "spans"])


def cut(text: bytes, spans: list[int] | None) -> tuple[int, int, bytes]:
    """Number of words, of words removed, and the words kept, joined by one space."""
    words = text.split()
    n = len(words)
    for s in reversed(spans or ()):
        del words[s >> 32 : s & 0xFFFFFFFF]
    return n, n - len(words), b" ".join(words)


def _distinct_key(rows: DataFrame):
    """A 64-bit hash of doc_id and text that no two different rows share.

    Where a second hash shows that rows with one hash differ, that hash takes its place. Of n
    rows n^2 / 2^65 pairs are expected to, 43 of 4e10, so a list of them is short.
    """
    first, second = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "doc_id", "text")
    both = rows.select(first.alias("a"), second.alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    shared = [r["a"] for r in both.where("low <> high").select("a").collect()]
    return F.when(first.isin(shared), F.xxhash64(second, first)).otherwise(first) if shared else first


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = BATCHES, remember: bool = False, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document.

    Documents come to the index in batches. Texts of fewer than WINDOW words keep
    all words; a null text has none; a null id is an id. Repeated rows repeat each other's windows;
    other columns are ignored; an empty table gives no rows. remember: the index keeps the
    windows for later calls, to which they are places elsewhere.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark)
    past = index.past()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", _distinct_key(rows).alias("key"), "text")
    hits = None
    for b in range(batches):
        new = index.ingest(rows.where(F.pmod(F.col("key"), F.lit(batches)) == b))
        hits = new if hits is None else hits.unionByName(new)
    spans = repeats(rows, hits, index.window, index.gram, past)
    if remember:
        index.remember(rows)
    touched = IdFilter(spans, "key", raw=True)
    bits, held = touched.bits, touched.words
    extra = ", kept_text string" * with_text

    def finished(ids, texts: list[bytes], lists: list) -> pa.RecordBatch:
        out = [cut(t, s) for t, s in zip(texts, lists, strict=True)]
        arrays = [ids, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays, names = [*arrays, pa.array([x[2].decode("utf-8", "replace") for x in out], pa.string())], [*names, "kept_text"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK_BYTES):
            b = batch.column(1).to_numpy() & (bits - 1)
            batch = batch.filter(pa.array((held.value[b >> 6] >> (b & 63)) & 1 == 0))
            if batch.num_rows:
                yield finished(batch.column(0), raw_texts(batch), [None] * batch.num_rows)

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK_BYTES):
            yield finished(batch.column(0), raw_texts(batch), batch.column(2).to_pylist())

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + extra
    whole = rows.mapInArrow(lean(untouched), schema)
    joined = touched.keep(rows, "key").join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans")
    return whole.unionByName(joined.mapInArrow(lean(shortened), schema))
