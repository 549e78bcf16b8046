"""Token ids in Simple-8b files.

A 64-bit word has a 4-bit selector and 60 bits of payload. Selector 0 is an
escape: the next word is one raw id. Selector 1 stands for 120 zeros. Each other
selector packs a fixed count of ids in equal bits. Ids are coded in blocks of at
most BLOCK ids, each starting at a word of its own, so that blocks decode
independently and all words of a selector decode at once.

A file is: magic, version, counts (documents, ids, blocks, words, ids of the part
before), then per document its id and count of ids, per block its first word,
then the words; all little-endian 64-bit.

Files are kept as rows of a Parquet table (part, seq, payload): Spark writes and
commits them on any store, and a lost executor's files are written again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, lean, raw_texts, shared_dir
from .tokens import ENCODED_BYTES, END_ID, encoder, tokenizer_path

MAGIC, VERSION, HEAD = 0x3842534C54434F4E, 1, 7
BLOCK = 4096
FILE_IDS = 1 << 20
#: Fixed values of the format: ids a word and bits an id, by selector.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of uint64 ids, and each block's first word (one more at the end)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    room = np.minimum(np.arange(n, 0, -1), BLOCK - np.arange(n) % BLOCK)
    width = np.zeros(n, np.uint8)
    ranks = BITS[1:]  # 0, 1, 2, ... 60
    for b in ranks:
        width += (ids >> np.uint64(b)) > 0  # bits needed exceed b
    selector = np.zeros(n, np.uint8)
    # longest runs first: a selector fits if the widest id of its run is narrow enough
    reach = {1: width}
    run, step = width, 1
    while step < 64:
        ahead = np.full(n, 0, np.uint8)
        ahead[: max(0, n - step)] = run[step:]
        run = np.maximum(run, ahead)
        step *= 2
        reach[step] = run

    def widest(count: int) -> np.ndarray:
        power = 1 << (count.bit_length() - 1)
        base = reach[power]
        shift = count - power
        if not shift:
            return base
        other = np.zeros(n, np.uint8)
        if n > shift:
            other[: n - shift] = base[shift:]
        return np.maximum(base, other)

    todo = np.ones(n, bool)
    for s in range(1, 16):
        fits = todo & (room >= COUNTS[s])
        if fits.any():
            fits &= widest(COUNTS[s]) <= s - 1
            selector[fits] = s
            todo &= ~fits
    used = np.array(COUNTS, np.int64)[selector]
    # all blocks step through their ids together
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    is_start = np.zeros(n, bool)
    while len(at):
        is_start[at] = True
        at = at + used[at]
        more = at < ends
        at, ends = at[more], ends[more]
    starts = np.flatnonzero(is_start)
    chosen = selector[starts]
    size = 1 + (chosen == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        first, out = starts[mine], place[mine]
        if s == 0:
            words[out + 1] = ids[first]
            continue
        word = np.full(len(first), s, np.uint64)
        if s > 1:
            for k in range(COUNTS[s]):
                word |= ids[first + k] << np.uint64(4 + k * BITS[s])
        words[out] = word
    block_first = np.concatenate([place[np.searchsorted(starts, np.arange(0, n, BLOCK))], [len(words)]])
    return words, block_first.astype(np.int64)


def decode(words: np.ndarray, block_first: np.ndarray) -> np.ndarray:
    """The ids of all blocks. An escape's raw word is told from a selector by a walk over escapes only."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(n, bool)
    for at in np.flatnonzero(selector == 0):
        if not raw[at] and at + 1 < n:
            raw[at + 1] = True
    lead = np.flatnonzero(~raw)
    chosen = selector[lead]
    count = np.array(COUNTS, np.int64)[chosen]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        at, to = lead[mine], place[mine]
        if s == 0:
            out[to] = words[at + 1]
        elif s > 1:
            mask = np.uint64((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                out[to + k] = (words[at] >> np.uint64(4 + k * BITS[s])) & mask
    return out


def decode_block(words: np.ndarray, block_first: np.ndarray, block: int) -> np.ndarray:
    """One block alone."""
    a, b = int(block_first[block]), int(block_first[block + 1])
    return decode(words[a:b], np.array([0, b - a]))


def to_file(doc_ids: list[int], counts: list[int], ids: np.ndarray, before: int) -> bytes:
    words, block_first = encode(ids)
    head = np.array([MAGIC, VERSION, len(doc_ids), len(ids), len(block_first) - 1, len(words), before], "<i8")
    return b"".join([head.tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), block_first.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def from_file(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc ids, counts, ids, ids of the part before this file."""
    magic, version, docs, n, blocks, words, before = np.frombuffer(payload, "<i8", HEAD).tolist()
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    at = 8 * HEAD
    take = lambda dtype, size: np.frombuffer(payload, dtype, size, at)
    doc_ids = take("<i8", docs)
    at += 8 * docs
    counts = take("<i8", docs)
    at += 8 * docs
    first = take("<i8", blocks + 1)
    at += 8 * (blocks + 1)
    ids = decode(take("<u8", words), first)
    if len(ids) != n:
        raise ValueError("a token file is damaged")
    return doc_ids, counts, ids, before


NO_ID = -(1 << 63)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes all documents in ascending doc_id order (null ids first; equal ids by text).

    Parts are ranges of (doc_id, hash of the text); a part's rows are sorted and
    encoded one file after the other, so memory holds one file at most (a
    document is never divided).
    """
    where = tokenizer or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = encoder(where), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        keys: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []
        seq = before = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, counts, held, seq, before, total
            payload = to_file(keys, counts, np.frombuffer(b"".join(held), "<u4"), before)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before + total], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "until", "payload"])
            keys, counts, held, seq, before, total = [], [], [], seq + 1, before + total, 0
            return out

        for batch in chunks(batches, most=ENCODED_BYTES):
            for key, ids in zip(batch.column(0).to_pylist(), coder.encode(raw_texts(batch)), strict=True):
                keys.append(NO_ID if key is None else key)
                counts.append(len(ids) // 4 + 1)
                held += (ids, end)
                total += counts[-1]
                if total >= FILE_IDS:
                    yield flush()
        if keys:
            yield flush()

    rows.mapInArrow(lean(encoded, keeps=True), "part int, seq int, until long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, uint32) of each document, decoded from the files."""
    files = spark.read.schema("part int, seq int, until long, payload binary").parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids, before = from_file(payload)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                starts = ends - counts
                cut = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array([part] * len(cut), pa.int32()), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts + before), pa.array(counts), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array([bytes(x) for x in cut], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    docs = files.select("part", "payload").mapInArrow(lean(decoded), "part int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    totals = files.groupBy("part").agg(F.max("until").alias("n"))  # a row a part of the writing job
    first = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    out = docs.join(F.broadcast(first), "part")
    return out.select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_digest(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes token files and returns what reading them gives.

    A null text counts as empty and has the end id alone. Repeated rows are
    documents of their own. An empty table gives no file rows and no result.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/conceptloom/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
