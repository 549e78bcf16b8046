"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set is its distinct word shingles, as 64-bit hashes. The universe is
hashed into segments whose number depends on the size band of the smaller set
of a pair. Two sets that link differ in at most H shingles (H grows with the
band). If the segments' budgets add up to more than H, some segment is matched:
a segment with budget 1 is indexed as it is (matched when equal), one with budget
2 with its one-deletion neighbourhood too (unmatched only if two shingles
differ). Allocation is by cost, band by band: the signatures it takes against
the coincidences that small segments bring. Segments of at most one shingle say
little; each band has some segments to spare, so that sets with no more of
these than that need not index them.

Sets that share a signature form a family; every linked pair lies within one. A set is in
several families, but families are not chained together, which would join much of a large table. Families are cut into classes of size so wide that sets
that link lie in one class or in neighbouring ones, and classes into blocks of bounded
size. First sketches of the sets in the blocks of a class and of the next are compared, which
bound from above what two sets have in common, and families are narrowed to sets that may link;
then these are verified exactly, by counting common shingles for all pairs of two blocks
at once. Equal sets are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, Words, chunks, components, lean, mix, raw_texts, row_keys, sorted_groups, spare_names, windows, without_rows, word_hashes, written

#: Percent of the union that a link takes, and words a shingle.
PERCENT, WORDS = 90, 3
BAND = 1.4
#: From this threshold on segments are large enough to do without those of one shingle; what a coincidence costs.
STRICT_PERCENT, STRICT_RISK, LOOSE_RISK = 88, 60.0, 2.0
#: A family is verified in blocks of so many documents or shingles at most (a document is never divided).
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20
#: The same for sketches; sketches that meet all others at once, and cells whose pairs go out together.
SKETCHED_DOCS, SKETCHED_SHINGLES, AT_ONCE, PAIRED = 4096, 1 << 24, 256, 1000
#: Bytes of text whose signatures are held at once, and words whose hashes are kept.
SIGNED_BYTES, KEPT_WORDS = 1 << 20, 150_000


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles; fewer words than a shingle count as one, no word as none."""
    n = len(hashes)
    return np.unique(windows(hashes, min(n, words), 0 if n >= words else n)) if n else np.zeros(0, np.uint64)


class Scheme:
    """Signatures of one threshold."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low, self.risk = (1, STRICT_RISK) if percent >= STRICT_PERCENT else (0, LOOSE_RISK)
        self.least = next(n for n in range(1, 10_000) if self.most_differing(n))  # smaller sets link only if equal

    def most_differing(self, size: int) -> int:
        """The largest symmetric difference of a set of `size` and a set at least as large that it links with."""
        larger = size * 100 // self.percent
        return max((size + s) * (100 - self.percent) // (100 + self.percent) for s in (size, larger))

    @lru_cache(maxsize=100_000)  # noqa: B019  lives as long as the worker
    def band_of(self, size: int) -> int:
        return -1 if size < self.least else int(math.log(size / self.least + 1e-12) / math.log(BAND))

    @lru_cache(maxsize=10_000)  # noqa: B019
    def plan(self, band: int) -> tuple[int, int, int]:
        """(segments, budget of each, segments to spare) of a band."""
        sizes = self.limits(band)
        h = max(self.most_differing(s) for s in {sizes[0], sizes[1]} | set(range(max(sizes[0], sizes[1] - 100), sizes[1] + 1)))
        spare = 1
        for _ in range(20):
            m = h + 1 + spare
            at = sizes[0] / m
            need = math.ceil(1.2 * m * math.exp(-at) * (1 + at * self.low)) + 1
            if need <= spare:
                break
            spare = need
        exact = (m + self.risk * m * math.exp(-at) * (1 + at + at * at / 2), m, 1, spare)
        m = -(-(h + 1) // 2)
        at = sizes[0] / m
        deletion = (sizes[1] + m + self.risk * m * math.exp(-at) * (1 + at + at * at / 2 + at**3 / 6), m, 2, 0)
        return min(exact, deletion)[1:]

    @lru_cache(maxsize=10_000)  # noqa: B019
    def limits(self, band: int) -> tuple[int, int]:
        """The smallest and the largest size of a band."""
        lo = max(self.least, int(self.least * BAND**band) - 2)
        while self.band_of(lo) < band:
            lo += 1
        hi = lo
        step = max(1, int(lo * BAND))
        while step:
            while self.band_of(hi + step) == band:
                hi += step
            step //= 2
        return lo, hi

    def bands(self, size: int) -> list[int]:
        """Bands of the sets, no larger than this one, that it may link with."""
        if size < self.least:
            return []
        smallest = max(self.least, -(-size * self.percent // 100))
        return list(range(self.band_of(smallest), self.band_of(size) + 1))

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        out = [self._of(shingles, band) for band in self.bands(len(shingles))]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def _of(self, shingles: np.ndarray, band: int) -> np.ndarray:
        m, budget, spare = self.plan(band)
        x = mix(shingles ^ np.uint64(0xA0761D6478BD642F))
        segment = ((x >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        x = mix(x + np.uint64(band))
        order = np.argsort(segment, kind="stable")
        segment, x = segment[order], x[order]
        count = np.bincount(segment, minlength=m)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        ends = np.cumsum(count)
        whole = total[ends] - total[ends - count]
        seed = np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([band * 2 + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if budget == 2:
            return np.concatenate([mix(whole ^ seed), mix((whole[segment] - x) ^ seed[segment])])
        keep = count > self.low
        if (~keep).sum() > spare:
            keep[:] = True
        return mix(whole ^ seed)[keep]


def _word_table() -> Words:
    return Words(lambda new: {"h": word_hashes(new)}, KEPT_WORDS)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & (1 << 64) - 1))


def prepared(rows: DataFrame, words: int = WORDS, known: IdFilter | None = None) -> DataFrame:
    """rows without their text, and n (shingles), k1 and k2 (a 128-bit digest of the set) of each; of those alone whose id is known."""
    (n, k1, k2), kept = spare_names(rows, "n", "k1", "k2"), [c for c in rows.columns if c != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table()
        for batch in chunks(batches, most=SIGNED_BYTES):
            found = [(len(s), *digest(s)) for s in _shingle_sets(table, raw_texts(batch), words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=[*kept, n, k1, k2])

    schema = rows.select(*kept).schema
    for c in (n, k1, k2):
        schema = schema.add(c, "long")
    return rows.mapInArrow(lean(sets), schema) if known is None else known.keep(rows, "id", then=sets, schema=schema)


def _shingle_sets(table: Words, texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    ids, ends = table.indices([t.lower().split() for t in texts])
    h = table.columns["h"][ids] if len(ids) else np.zeros(0, np.uint64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield shingle_set(h[a:b], words)


def shared_groups(rows: DataFrame, known: IdFilter, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """family, a: the sets (by the first half of their digests) that share a signature; groups of the same sets are one family.

    rows: id, text; those count whose id is known. Signatures are dealt once, and a group that spans batches is held as two numbers a set.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scheme = _word_table(), Scheme(percent)
        for batch in chunks(batches, most=SIGNED_BYTES):
            sets = {digest(x)[0]: x for x in _shingle_sets(table, raw_texts(batch), words) if len(x)}
            if not sets:
                continue
            found = [scheme.signatures(x) for x in sets.values()]
            node = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(node)], names=["s", "a"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the signature that may go on
        for batch in batches:
            s, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(s):
                continue
            if s[0] == s[-1] and (not held or held[0][0][0] == s[0]):
                held.append((s, a))
                continue
            upto = int(np.searchsorted(s, s[-1]))
            done = [*held, (s[:upto], a[:upto])]
            held = [(s[upto:], a[upto:])]
            yield _families(*map(np.concatenate, zip(*done, strict=True)))
        if held:
            yield _families(*map(np.concatenate, zip(*held, strict=True)))

    dealt = known.keep(rows, "id", then=signed, schema="s long, a long").repartition("s").sortWithinPartitions("s", "a")
    return dealt.mapInArrow(lean(gathered), "family long, a long").distinct()


def _families(s: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """family, a: of sorted signatures the sets of each that has two or more; a family's name is made of its sets alone."""
    new = np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1]))[: len(s)]
    s, a = s[new], a[new]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    size = np.diff(np.append(starts, len(s)))
    name = mix(np.add.reduceat(mix(a.view(np.uint64)), starts) + size.astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
    at = np.unique(name, return_index=True)[1]
    at = at[size[at] > 1]
    size = size[at]
    rows = np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(name[at].view(np.int64), size)), pa.array(a[rows])], names=["family", "a"])


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Numbers of common elements of all pairs of sets; only elements of two sets or more are counted, `width` at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    owner, column = owner[keep], rank[inverse[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which pairs link, exactly; no set links with itself."""
    both = common_counts(sets)
    n = np.array([len(s) for s in sets])
    out = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def placed_in_cells(members: DataFrame, percent: int, block_docs: int | None = None, block_shingles: int | None = None) -> tuple[DataFrame, Column]:
    """members with their family's class of size and block, and the cells that they go to: pairs of blocks of one class, or of it and the next."""
    # sizes of sets that link have a ratio of at most 100 / percent; a little more leaves room for rounding
    width = 1.0001 * math.log(100 / percent)
    members = members.withColumn("class", F.floor(F.log("n") / width).cast("int"))
    sizes = members.groupBy("family", "class").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / (block_docs or BLOCK_DOCS)), F.ceil(F.col("shingles") / (block_shingles or BLOCK_SHINGLES))).cast("int")
    sizes = written(sizes.select("family", "class", blocks.alias("blocks")), "classes")
    beside = lambda by, name: sizes.select("family", (F.col("class") + by).alias("class"), F.col("blocks").alias(name))
    sizes = sizes.join(beside(-1, "above"), ["family", "class"], "left").join(beside(1, "below"), ["family", "class"], "left")
    placed = members.join(sizes, ["family", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cell = lambda first, upper, i, j: F.struct(first.alias("first"), F.lit(upper).alias("upper"), i.alias("i"), j.alias("j"))
    each = lambda n, of: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), of)
    own = F.col("block")
    return placed, F.concat(
        each("blocks", lambda j: cell(F.col("class"), 0, F.least(j, own), F.greatest(j, own))),
        each("above", lambda j: cell(F.col("class"), 1, own, j)),
        each("below", lambda j: cell(F.col("class") - 1, 1, j, own)),
    )


_CELL = ["family", "first", "upper", "i", "j"]


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Each cell's nodes, once each, and which pairs of them the cell is to tell about."""
    for group in sorted_groups(batches, _CELL):
        node = group["node"].to_numpy()
        group = group.take(pa.array(np.flatnonzero(np.append(True, node[1:] != node[:-1])))).combine_chunks()  # rows with one set are one node
        upper = group["upper"][0].as_py()
        side = group["class" if upper else "block"].to_numpy()
        if upper or group["i"][0].as_py() != group["j"][0].as_py():
            yield group, side[:, None] != side[None, :]
        else:
            yield group, ~np.eye(len(side), dtype=bool)


def spanning(links: np.ndarray) -> np.ndarray:
    """Of each node the smallest place that links lead to."""
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def sketch(shingles: np.ndarray) -> bytes:
    """Numbers of shingles in bins of their low bits, four to eight a bin; empty if one is beyond a byte."""
    bins = 1 << max(5, len(shingles).bit_length() - 3)
    count = np.bincount((mix(shingles) & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def most_common(sketches: list[bytes], n: np.ndarray, own: np.ndarray | slice = slice(None)) -> np.ndarray:
    """For pairs of those of `own` with all, a number of common shingles that they can't exceed: no bin has more in common than the smaller of its numbers."""
    out = np.minimum(n[own, None], n[None, :]).astype(np.float32)
    told = np.array([k for k, x in enumerate(sketches) if x], np.int64)
    if not len(told):
        return out
    bins = min(len(sketches[k]) for k in told)
    counts = np.array([np.frombuffer(sketches[k], np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.int64) for k in told])
    place = np.full(len(n), -1)
    place[told] = np.arange(len(told))
    rows = np.flatnonzero(place[own] >= 0)
    few = counts[place[own][rows]]
    both = np.zeros((len(rows), len(told)), np.float32)
    for t in range(1, int(few.max(initial=0)) + 1):
        both += (few >= t).astype(np.float32) @ (counts >= t).astype(np.float32).T
    out[np.ix_(rows, told)] = both
    return out


def possible_groups(sketches: list[bytes], n: np.ndarray, side: np.ndarray, percent: int, most: int = AT_ONCE) -> np.ndarray:
    """Of each set the smallest place that links lead to that sketches allow, between sides or, if there is but one, between all.

    Pairs that others join already are not compared: `most` sets at a time meet all that are left, those of the smallest groups
    first, until what is left is one group. So many near copies take few comparisons.
    """
    label, left = np.arange(len(n)), np.arange(len(n))
    split = bool((side != side[0]).any())
    while len(left) > 1:
        size = np.bincount(label[left], minlength=len(n))[label[left]]
        if size[0] == len(left):
            break
        chosen = np.argsort(size, kind="stable")
        chosen = chosen[:: max(1, len(chosen) // most)][:most] if size.max() == 1 else chosen[:most]
        both = most_common([sketches[k] for k in left], n[left], chosen)
        hit = 100 * both >= percent * (n[left][chosen][:, None] + n[left][None, :] - both)
        if split:
            hit &= side[left][chosen][:, None] != side[left][None, :]
        i, j = np.nonzero(hit)
        i, j = left[chosen[i]], left[j]
        while True:
            low, now = np.minimum(label[i], label[j]), label.copy()
            np.minimum.at(now, label[i], low)
            np.minimum.at(now, label[j], low)
            while (now[now] != now).any():
                now = now[now]
            now = now[label]
            if (now == label).all():
                break
            label = now
        left = np.delete(left, chosen)
    return label


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """node, n, sketches and sides of each cell, nodes once each; rows are sorted by cell and node."""
    held = None
    for batch in chain(batches, [None]):
        parts = [x for x in (held, batch) if x is not None and x.num_rows]
        if not parts:
            continue
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key = [rows.column(rows.schema.get_field_index(c)).to_numpy() for c in _CELL]
        new = np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in key]))[: rows.num_rows]
        cuts = np.append(np.flatnonzero(new), rows.num_rows)
        if batch is not None:  # the last cell may go on
            held, cuts = rows.slice(cuts[-2]), cuts[:-1]
        node, n, block, class_ = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("node", "n", "block", "class"))
        sketches = rows.column(rows.schema.get_field_index("sketch")).to_pylist()
        upper, i, j = key[2], key[3], key[4]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = a + np.flatnonzero(np.append(True, node[a + 1 : b] != node[a : b - 1]))  # rows with one set are one node
            side = class_[at] if upper[a] else block[at] if i[a] != j[a] else np.zeros(len(at), np.int64)
            yield node[at], n[at], [sketches[k] for k in at.tolist()], side


def narrowed(members: DataFrame, rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """members, once each, with families of only those that may link by their sketches, directly or by others; no pair that links is parted.

    members: a row a set and family that it is in. Sketches, some thirty times smaller than texts, are what goes to all cells, so
    sets that merely share a passage are parted before any text is sent more than once.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table()
        for batch in chunks(batches, most=SIGNED_BYTES):
            sets = [x for x in _shingle_sets(table, raw_texts(batch), words) if len(x)]
            if sets:
                k1, k2 = zip(*map(digest, sets), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())], names=["k1", "k2", "sketch"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        for node, n, sketches, side in cells(batches):
            label = possible_groups(sketches, n, side, percent)
            some = np.flatnonzero(label != np.arange(len(label)))
            if len(some):
                pairs.append(np.stack([node[some], node[label[some]]]))
            if len(pairs) >= PAIRED:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(pairs, axis=1), axis=1)], names=["a", "b"])
                pairs = []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(pairs, axis=1), axis=1)], names=["a", "b"])

    placed, at = placed_in_cells(members, percent, SKETCHED_DOCS, SKETCHED_SHINGLES)
    made = IdFilter(members.select("id").distinct(), "id").keep(rows, "id", then=sketched, schema="k1 long, k2 long, sketch binary")
    made = made.join(placed.drop("id", "copies"), ["k1", "k2"]).select("family", "class", "node", "n", "block", "sketch", F.explode(at).alias("p"))
    made = made.select("family", "p.*", "class", "node", "n", "block", "sketch").repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    families = components(made.mapInArrow(lean(possible), "a long, b long"), "narrowed")
    return members.drop("family").distinct().join(families.withColumnRenamed("root", "family"), "node")


def verified(members: DataFrame, rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """node, to, links: edges that span the components of the links within each cell, and numbers of rows linked.

    members: node, k1, k2, id (of a row with the set), family, n, copies (rows with the set).
    """
    placed, cells = placed_in_cells(members, percent)
    # the set of a row tells whether it is a member's; ids only spare the others the trouble
    texts = prepared(rows.select("id", "text", F.col("text").alias("words")), words, IdFilter(members, "id")).drop("id", "n").join(placed.drop("id", "n"), ["k1", "k2"])
    texts = texts.select("family", "class", "node", "block", "copies", F.coalesce("words", F.lit("")).alias("text"), F.explode(cells).alias("p")).select("family", "p.*", "class", "node", "block", "copies", "text")
    texts = texts.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table()
        for group, wanted in by_cell(batches):
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            links = linked(list(_shingle_sets(table, raw_texts(group.to_batches()[0]), words)), percent) & wanted
            label, some = spanning(links), links.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label][some]), pa.array((links @ copies)[some].astype(np.int64))], names=["node", "to", "links"])

    return texts.mapInArrow(lean(checked), "node long, to long, links long")


_NO_ID = -(1 << 63)


def components_of(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """rows (id, text and others) without text, and n, group, smallest (id of the group, null if it has none) and links.

    Every row counts on its own, whatever its id. Rows without a word have no group.
    """
    keyed = rows.withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)))
    table = written(prepared(keyed, words), "sets")
    sets = table.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != _NO_ID, F.col("id"))).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # some copies pass as well; they lead to their own family
    narrow = keyed.select("id", "text")
    families = shared_groups(narrow, IdFilter(sets, "id"), percent, words)
    members = sets.drop("least").join(families.withColumnRenamed("a", "k1"), "k1")
    members = written(narrowed(written(members, "members"), narrow, percent, words), "narrowed")
    found = written(verified(members, narrow, percent, words), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = sets.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).join(links, "node", "left")
    least = own.groupBy("group").agg(F.min("least").alias("smallest"))
    own = own.join(least, "group").select("k1", "k2", "group", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return table.join(own, ["k1", "k2"], "left").drop("k1", "k2").withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row.

    Null and empty texts link with nothing. Rows with one id, or none, are documents of
    their own: repeated rows link with each other. A component without any id has a
    null component_id. No partner or candidate is capped; other columns are ignored;
    an empty table gives no rows.
    """
    out = components_of(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), percent, words)
    full = F.col("n") > 0
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(full, F.col("smallest")).otherwise(F.col("id")).alias("component_id"), F.when(full, F.col("links")).otherwise(0).alias("n_links"))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs, with all their columns, without those rows that link with one that stays: of each component the row with the smallest id.

    A null id comes after all others; of rows with equal ids one stays. Only texts that
    link are dropped: rows that merely share an id, or have none, stay. Null and
    empty texts stay, all of them.
    """
    (a, b), (first, second) = spare_names(docs, "_a", "_b"), row_keys(docs)
    keyed = docs.withColumn(a, first).withColumn(b, second)
    rows = components_of(keyed.select(F.col("doc_id").alias("id"), "text", F.col(a).alias("a"), F.col(b).alias("b")), percent, words).where("n > 0")
    rows = written(rows.select("id", "a", "b", "group"), "grouped")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("a").alias("a"), F.col("b").alias("b"))
    stay = rows.groupBy("group").agg(F.min(order).alias("s"), F.count("*").alias("n")).where("n > 1")
    special = rows.join(stay, "group").groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.max((F.col("a") == F.col("s.a")) & (F.col("b") == F.col("s.b"))).alias("keep"), F.count("*").alias("n"))
    special = written(special.where("not keep or n > 1").select(a, b, "keep"), "special")
    return without_rows(keyed, special, [a, b]).select(*[F.col(f"`{c}`") for c in docs.columns])
