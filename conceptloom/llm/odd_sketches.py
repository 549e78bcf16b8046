"""Near duplicates by MinHash bands and odd sketches.

A document's set is its distinct word shingles. SAMPLES minima of it, by as many hash functions,
serve twice. Bands of ROWS minima each bring candidates: sets that share a band, directly or by
others, form a family. All minima are folded into a bitmap of BITS bits, in which each turns over
the bit that it falls on (an odd sketch). The number of bits in which two bitmaps differ tells how many
minima do, more precisely the more similar the sets; pairs whose bitmaps differ in more bits
than linked sets' ever would are ruled out. What is left is verified exactly, on full sets.

Chances of losing a link are set by RISK: a pair at the threshold shares no band, or differs in more
bits than allowed, in less than one case in 10^12. Everything after the candidates is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, components, lean, mix, raw_texts, sorted_groups, spare_names, word_hashes, written
from .jaccard_join import by_cell, digest, placed_in_cells, shingle_set, spanning, verified

#: Percent of the union that a link takes, and words a shingle.
PERCENT, WORDS = 85, 3
#: Minima of a band; bits of a sketch; the chance that either test fails a link.
ROWS, BITS, RISK = 5, 1024, 1e-12
#: Bytes of text whose sets are held at once, words whose hashes are kept, sets whose bands are joined at once.
SIGNED_BYTES, KEPT_WORDS, JOINED_SETS = 1 << 20, 150_000, 4096
_NO_ID = -(1 << 63)


@lru_cache(maxsize=100)
def bands_for(percent: int) -> int:
    """Bands enough that a pair at the threshold misses them all in RISK of cases at most."""
    miss = 1 - (percent / 100) ** ROWS
    return max(1, int(np.ceil(np.log(RISK) / np.log(miss)))) if miss > 0 else 1


@lru_cache(maxsize=100)
def most_apart(percent: int, samples: int) -> int:
    """The number of differing bits that sets at the threshold exceed in RISK of cases at most.

    Of the minima each differs with chance 1 - percent / 100; a minimum that differs turns over one bit in
    each sketch. The chances of so many odd bits are followed turn by turn.
    """
    differs = 1 - percent / 100
    odd = np.zeros(BITS + 1)
    odd[0] = 1.0
    up, down = 1 - np.arange(BITS + 1) / BITS, np.arange(BITS + 1) / BITS
    share, total = (1 - differs) ** samples, np.zeros(BITS + 1)
    for k in range(samples + 1):
        total += share * odd
        share *= (samples - k) / (k + 1) * differs / (1 - differs) if differs < 1 else 0
        for _ in range(2):
            turned = np.zeros(BITS + 1)
            turned[1:] += (odd * up)[:-1]
            turned[:-1] += (odd * down)[1:]
            odd = turned
    beyond = np.cumsum(total[::-1])[::-1]  # chance of so many bits or more
    return int(np.flatnonzero(beyond > RISK).max(initial=0))


def multipliers(samples: int) -> np.ndarray:
    return np.random.default_rng(20140407).integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """Of each set (none is empty) the smallest value by each hash function."""
    flat = mix(np.concatenate(sets))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), samples), np.uint64)
    for k, a in enumerate(multipliers(samples)):
        out[:, k] = np.minimum.reduceat(flat * a, starts)
    return out


def banded(found: np.ndarray) -> np.ndarray:
    """One value a band; bands of different places are told apart."""
    n, samples = found.shape
    out = np.arange(samples // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((n, 1), np.uint64)
    for k in range(ROWS):
        out = out * np.uint64(0x5851F42D4C957F2D) + found[:, k : samples // ROWS * ROWS : ROWS]
        out ^= out >> np.uint64(29)
    return mix(out)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Bitmaps, one row of bytes a set: each minimum, told by its place too, turns over a bit."""
    n, samples = found.shape
    bit = mix(found + np.arange(samples, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(BITS - 1)
    at = (bit.astype(np.int64) + np.arange(n)[:, None] * BITS).ravel()
    return np.packbits((np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def differing(sketches: np.ndarray) -> np.ndarray:
    """For all pairs the number of bits in which they differ. sketches: rows of 64-bit words."""
    out = np.empty((len(sketches), len(sketches)), np.int64)
    for k, own in enumerate(sketches):
        out[k] = np.bitwise_count(sketches ^ own).sum(axis=1)
    return out


def similarity(apart: np.ndarray, samples: int) -> np.ndarray:
    """The similarity that so many differing bits tell of."""
    return 1 + BITS / (4 * samples) * np.log(np.maximum(1 - 2 * apart / BITS, 1e-9))


def sketched(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """rows (text and others) without text, and n (shingles), k1 and k2 (a digest of the set), bands and sketch.

    Of equal sets in one chunk of text, the first has bands and sketch; empty sets have none.
    """
    (n, k1, k2, bands, bitmap), kept = spare_names(rows, "n", "k1", "k2", "bands", "sketch"), [c for c in rows.columns if c != "text"]
    samples = bands_for(percent) * ROWS

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(lambda new: {"h": word_hashes(new)}, KEPT_WORDS)
        for batch in chunks(batches, most=SIGNED_BYTES):
            ids, ends = table.indices([t.lower().split() for t in raw_texts(batch)])
            h = table.columns["h"][ids] if len(ids) else np.zeros(0, np.uint64)
            sets = [shingle_set(h[a:b], words) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            keys = [digest(s) for s in sets]
            first = {k: at for at, k in reversed(list(enumerate(keys))) if len(sets[at])}
            told: list[tuple[bytes | None, bytes | None]] = [(None, None)] * len(sets)
            if first:
                at = sorted(first.values())
                found = minima([sets[k] for k in at], samples)
                for k, b, s in zip(at, banded(found), odd_sketch(found), strict=True):
                    told[k] = (b.tobytes(), s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in kept),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(x, pa.int64()) for x in zip(*keys, strict=True)),
                    *(pa.array(x, pa.binary()) for x in zip(*told, strict=True)),
                ],
                names=[*kept, n, k1, k2, bands, bitmap],
            )

    schema = rows.select(*kept).schema
    for name, kind in ((n, "long"), (k1, "long"), (k2, "long"), (bands, "binary"), (bitmap, "binary")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(lean(signed), schema)


def smallest_of(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values with the smallest node of each, and edges of the other nodes to it."""
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    new = np.append(True, value[1:] != value[:-1])[: len(value)]
    low = node[new][np.cumsum(new) - 1]
    return value[new], node[new], np.unique(np.stack([node[node != low], low[node != low]]), axis=1)


def band_edges(sets: DataFrame) -> DataFrame:
    """a, b: of the sets that share a band, each with the smallest. sets: k1, bands.

    Sets that meet in one batch are joined there and the smallest stands for them, so a
    band that very many share is a row a batch; these are dealt by band, once.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, JOINED_SETS):
                part = batch.slice(at, JOINED_SETS)
                bands = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(part.num_rows, -1)
                value, node, edges = smallest_of(bands.ravel(), np.repeat(part.column(0).to_numpy(), bands.shape[1]))
                none = np.arange(len(value) + edges.shape[1]) < len(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([value, edges[0]])), pa.array(np.concatenate([node, edges[0]])), pa.array(np.concatenate([node, edges[1]]), mask=none)], names=["s", "a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, 0
        for batch in batches:
            done = batch.filter(batch.column(2).is_valid()).select(["a", "b"])
            if done.num_rows:
                yield done
            open_ = batch.filter(batch.column(2).is_null())
            if not open_.num_rows:
                continue
            value, node = open_.column(0).to_numpy(), open_.column(1).to_numpy()
            if last == value[0]:  # a band that began in the batch before
                value, node = np.concatenate([value[:1], value]), np.concatenate([[least], node])
            values, lows, edges = smallest_of(value, node)
            last, least = values[-1], lows[-1]
            if edges.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    dealt = sets.select("k1", "bands").mapInArrow(lean(met), "s long, a long, b long").repartition("s").sortWithinPartitions("s", "a")
    return dealt.mapInArrow(lean(joined), "a long, b long")


_CELL = ["family", "first", "upper", "i", "j"]


def narrowed(members: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members with families of only those whose odd sketches allow a link, directly or by others."""
    samples = bands_for(percent) * ROWS
    most = most_apart(percent, samples)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, wanted in by_cell(batches):
            node = group["node"].to_numpy()
            bitmaps = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(node), -1)
            label = spanning(wanted & (differing(bitmaps) <= most))
            some = np.flatnonzero(label != np.arange(len(label)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], names=["a", "b"])

    placed, cells = placed_in_cells(members, percent)
    made = sketches.join(placed.drop("id", "copies", "n"), ["k1", "k2"]).select("family", "class", "node", "block", "blocks", "above", "below", "sketch", F.explode(cells).alias("p"))
    made = made.select("family", "p.*", "class", "node", "block", "sketch").repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    families = components(made.mapInArrow(lean(possible), "a long, b long"), "narrowed")
    return members.drop("family").join(families.withColumnRenamed("root", "family"), "node")


def classes_of(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """rows (id, text and others) without text, and n, group, smallest (id of the group, null if it has none) and links.

    Every row counts on its own, whatever its id. Rows without a word have no group.
    """
    keyed = rows.withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)))
    table = written(sketched(keyed, percent, words), "sketches")
    sets = table.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != _NO_ID, F.col("id"))).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    told = table.where("sketch is not null")
    families = components(band_edges(told), "families")
    members = written(sets.drop("least").join(families.select(F.col("node").alias("k1"), F.col("root").alias("family")), "k1"), "members")
    members = written(narrowed(members, told.select("k1", "k2", "sketch"), percent), "narrowed")
    found = written(verified(members, keyed.select("id", "text"), percent, words), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = sets.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).join(links, "node", "left")
    least = own.groupBy("group").agg(F.min("least").alias("smallest"))
    own = own.join(least, "group").select("k1", "k2", "group", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = table.drop("bands", "sketch").join(own, ["k1", "k2"], "left").drop("k1", "k2")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and kept of every row.

    kept: the row's id is the smallest of its component. Null and empty texts link with nothing and are
    kept. Rows with one id, or none, are documents of their own; a null id is in no
    component's name while another is there, and a row without an id is kept only if its component has no id
    at all. No partner or candidate is capped; other columns are ignored; an empty table gives no rows.
    """
    out = classes_of(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), percent, words)
    full = F.col("n") > 0
    component = F.when(full, F.col("smallest")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(full, F.col("links")).otherwise(0).alias("n_links"), F.col("id").eqNullSafe(component).alias("kept"))
