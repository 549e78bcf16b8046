"""Packing by shortest-pack-first over the length histogram.

Documents are token ids with an end id, cut into pieces of at most the
sequence length. Only the histogram of piece lengths (one count a length) comes
to the driver; there lengths are placed longest first, each into the open packs
with the most room, as whole ranges of sequence ids, so the work depends on the
number of distinct lengths alone. Pieces then find their place by their rank
among pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, ranked, raw_texts, written
from .tokens import ENCODED_BYTES, END_ID, encoder, tokenizer_path

SEQUENCE = 2048


@dataclass(frozen=True)
class Slots:
    """For pieces of `length` with ranks from `first` on: sequence `sequence` + rank - first, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 44) + self.first, (length << 44) + rank, "right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def pack_histogram(counts: dict[int, int], capacity: int = SEQUENCE) -> Slots:
    """Packs counts[length] pieces. A group is a range of sequences that are filled alike.

    Where no open pack has room, only as many packs are opened as the pieces at
    hand can fill, so a length that most pieces share is packed densely too.
    """
    rows: list[tuple[int, int, int, int]] = []
    open_packs: list[tuple[int, int, int]] = []  # (filled, first sequence, how many): the shortest pack is first
    sequences = 0
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit")
        left, rank = counts[length], 0
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                filled, base, many = heapq.heappop(open_packs)
            else:
                filled, base, many = 0, sequences, -(-left // (capacity // length))
                sequences += many
            use = min(left, many)
            rows.append((length, rank, base, filled))
            if use < many:
                heapq.heappush(open_packs, (filled, base + use, many - use))
            if filled + length < capacity:
                heapq.heappush(open_packs, (filled + length, base, use))
            left, rank = left - use, rank + use
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Slots(*(np.ascontiguousarray(table[:, k]) for k in range(4)), sequences)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its ids (little-endian uint32) if asked for."""
    path = tokenizer or tokenizer_path()
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in chunks(batches, most=ENCODED_BYTES):
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), coder.encode(raw_texts(batch)), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=False)], names=[n for n, _ in types])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(cut, keeps=True), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents: a row a piece, with sequence_id and offset in its sequence.

    A null or empty text is one piece that holds the end id alone; repeated
    rows are packed each; an empty table gives no row. Texts are encoded
    once: the pieces, narrow rows, are written to the shared folder.
    """
    cut = written(pieces(docs, tokenizer, capacity, doc_id, text, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = pack_histogram(histogram, capacity)
    numbered = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", rows=sum(histogram.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = slots.place(length, rank) if batch.num_rows else (length, rank)
            keep = [n for n in names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return numbered.select(*cut.columns, "_rank").mapInArrow(lean(place), schema)
