"""Hard negatives by a pivot table.

Every row has whole numbers as components. A further component, sqrt(M^2 - |x|^2) with M the
largest norm, brings all rows to one length; an anchor has 0 there. So a score is
(M^2 + |a|^2 - d^2) / 2, d being the Euclidean distance, and the largest scores are the nearest rows.

The pivot table keeps each row's distances to some pivots. By the triangle inequality they
bracket the distance to any anchor, and so the score: first for whole blocks of rows (the
table is ordered by nearest pivot and the distance to it, so blocks are narrow), then row by row. What
a bracket doesn't rule out is scored exactly.

Anchors go out in blocks of bounded size; a task reads its rows once a block and keeps, for each
anchor, the best rows so far, whose last score narrows what comes after.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, lean, ranked, shared_dir, written

#: Positives of an anchor, negatives of each, and the percents of the positive's score that a negative's may have.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Components are told in so many parts of one.
SCALE = 256
#: Pivots, and the rows among which they are sought.
PIVOTS, PIVOT_SAMPLE = 16, 1024
#: Rows looked at at once, anchors looked at at once, and anchors (and their bytes) in a block.
ROWS, SLICE, BLOCK, BLOCK_BYTES = 512, 1024, 8192, 16 << 20
#: A squared norm has to be below this, so that a hundred times a score is a long.
NORM_LIMIT = 1 << 56
_NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, embedding: str = "embedding", label: str = "label") -> DataFrame:
    """rows that take part, with x: the components as whole numbers.

    A row with a null label, a null vector, or a component that is null or not finite takes no part.
    """
    vector = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col(f"`{label}`").isNotNull() & vector.isNotNull() & fine).withColumn("x", F.transform(vector, lambda v: F.floor(v * SCALE)))


def farthest_first(sample: np.ndarray, many: int) -> np.ndarray:
    """Places of pivots: each the row farthest from those before."""
    if not len(sample):
        return np.zeros(0, np.int64)
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < many and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


class Pivots:
    """Pivots in the space with a further component."""

    def __init__(self, vectors: list[list[int]], norm2: int, width: int):
        self.norm2, self.width = float(norm2), width
        found = np.zeros((len(vectors), width + 1))
        for k, v in enumerate(vectors):
            found[k, : len(v)] = v
        found[:, width] = self.rest(found[:, :width])
        self.at = found[farthest_first(found, PIVOTS)]

    def rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Of rows, or of anchors (whose further component is 0), to all pivots."""
        near = x @ self.at[:, :-1].T
        if anchors:
            length2 = (x * x).sum(axis=1)[:, None]
        else:
            length2, near = self.norm2, near + self.rest(x)[:, None] * self.at[:, -1]
        return np.sqrt(np.maximum(0.0, length2 + self.norm2 - 2 * near))


def pivot_table(rows: DataFrame, width: int, pivots: Pivots) -> DataFrame:
    """row, id, label, anchor, v (components, four bytes each), d (distances to the pivots), in order of the nearest pivot and the distance to it.

    rows: id, label, anchor, x. Shorter vectors count as having zeros behind.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, width))
            for k, v in enumerate(batch.column(4).to_pylist()):
                x[k, : len(v)] = v
            d = pivots.distances(x)
            near = d.argmin(axis=1)
            packed = lambda a, kind: pa.array([r.tobytes() for r in a.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], packed(x, "<i4"), packed(d, "<f8"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                names=["row", "id", "label", "anchor", "v", "d", "near", "far"],
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "x")
    made = numbered.mapInArrow(lean(measured), "row long, id long, label long, anchor boolean, v binary, d binary, near int, far double")
    return made.repartitionByRange("near", "far", "row").sortWithinPartitions("near", "far", "row")


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.float64 if kind == "<f8" else np.int64)


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null (0 stands there)."""
    return np.asarray(column.fill_null(0), dtype=np.int64), ~np.asarray(column.is_valid())


class Best:
    """Of each slot the first rows by score, id (null last) and row."""

    COLUMNS = ("slot", "score", "none", "id", "row")

    def __init__(self, slots: int, most: int):
        self.most, self.floor = most, np.full(slots, _NONE, np.int64)
        self.held = {c: np.zeros(0, bool if c == "none" else np.int64) for c in self.COLUMNS}

    def add(self, **new: np.ndarray) -> None:
        held = {c: np.concatenate([self.held[c], new[c]]) for c in self.COLUMNS}
        order = np.lexsort((held["row"], held["id"], held["none"], -held["score"], held["slot"]))
        slot = held["slot"][order]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))[: len(slot)]
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        self.held = {c: held[c][order[rank < self.most]] for c in self.COLUMNS}
        last = order[rank == self.most - 1]
        self.floor[held["slot"][last]] = held["score"][last]


class Block:
    """Anchors of one block, and what a task has found for them."""

    def __init__(self, anchors: pa.Table, pivots: Pivots):
        self.row, self.label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        self.id, self.no_id = ids_of(anchors["id"].combine_chunks())
        self.v = matrix(anchors["v"].combine_chunks(), "<i4", pivots.width)
        self.pivots, self.exact = pivots, np.float64 if pivots.norm2 < 1 << 53 else np.int64
        self.length2 = (self.v.astype(np.float64) ** 2).sum(axis=1)
        self.d = pivots.distances(self.v.astype(np.float64), anchors=True)
        self.slack = 1e-6 * (self.length2 + pivots.norm2) + 1

    def highest(self, distance: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Scores that rows at this distance or farther don't exceed."""
        return ((self.pivots.norm2 + self.length2 + 2 * self.slack)[some, None] - distance**2) / 2

    def lowest(self, distance: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Scores that rows at this distance or nearer have at least."""
        return ((self.pivots.norm2 + self.length2 - 2 * self.slack)[some, None] - distance**2) / 2

    def survivors(self, d: np.ndarray, some: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchors among `some` for which the rows' bracket reaches [least, most], and a mask of rows for each."""
        lo, hi, own = d.min(axis=0), d.max(axis=0), self.d[some]
        gap = np.maximum(np.maximum(own - hi, lo - own), 0).max(axis=1, initial=0)[:, None]
        reach = (own + hi).min(axis=1, initial=np.inf)[:, None]
        ok = (self.highest(gap, some)[:, 0] >= least) & (self.lowest(reach, some)[:, 0] <= most)
        some, least, most, own = some[ok], least[ok], most[ok], own[ok]
        near, far = np.zeros((len(some), len(d))), np.full((len(some), len(d)), np.inf)
        for k in range(d.shape[1]):
            near = np.maximum(near, np.abs(own[:, k, None] - d[None, :, k]))
            far = np.minimum(far, own[:, k, None] + d[None, :, k])
        mask = (self.highest(near, some) >= least[:, None]) & (self.lowest(far, some) <= most[:, None])
        ok = mask.any(axis=1)
        return some[ok], mask[ok]

    def scores(self, v: np.ndarray, some: np.ndarray) -> np.ndarray:
        return (self.v[some].astype(self.exact) @ v.T.astype(self.exact)).astype(np.int64)


def row_blocks(batches: Iterator[pa.RecordBatch], width: int, pivots: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = lambda n: part.column(part.schema.get_field_index(n))  # noqa: B023, E731
            yield column("row").to_numpy(), *ids_of(column("id")), column("label").to_numpy(), matrix(column("v"), "<i4", width), matrix(column("d"), "<f8", pivots)


def positives_of(table: DataFrame, anchors: pa.Table, pivots: Pivots, many: int) -> DataFrame:
    """anchor (its place in the block), positive_row, positive_id, score, rank: the first rows with the anchor's label."""
    sent = table.sparkSession.sparkContext.broadcast(anchors)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(sent.value, pivots)
        best = Best(len(block.row), many)
        for row, ident, none, label, v, d in row_blocks(batches, pivots.width, len(pivots.at)):
            mine = np.flatnonzero(np.isin(block.label, label))
            for at in range(0, len(mine), SLICE):
                some = mine[at : at + SLICE]
                some, mask = block.survivors(d, some, best.floor[some].astype(np.float64), np.full(len(some), np.inf))
                mask &= (block.label[some, None] == label) & (block.row[some, None] != row)
                score = block.scores(v, some)
                a, k = np.nonzero(mask & (score >= best.floor[some, None]))
                if len(a):
                    best.add(slot=some[a], score=score[a, k], none=none[k], id=ident[k], row=row[k])
        h = best.held
        yield pa.RecordBatch.from_arrays([pa.array(h["slot"]), pa.array(h["row"]), pa.array(h["id"], mask=h["none"]), pa.array(h["score"])], names=["anchor", "positive_row", "positive_id", "score"])

    found = table.drop("near", "far").mapInArrow(lean(searched), "anchor long, positive_row long, positive_id long, score long")
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= many)


def negatives_of(table: DataFrame, anchors: pa.Table, positives: pa.Table, pivots: Pivots, many: int, low: int, high: int) -> DataFrame:
    """The result's rows of one block of anchors, each task's best first."""
    sent = table.sparkSession.sparkContext.broadcast((anchors, positives.combine_chunks()))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, pairs = sent.value
        block = Block(anchors, pivots)
        owner, score = pairs["anchor"].to_numpy(), pairs["score"].to_numpy()
        best = Best(len(owner), many)
        order = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[order], np.arange(len(block.row) + 1))
        having = np.flatnonzero(np.diff(first))
        for row, ident, none, label, v, d in row_blocks(batches, pivots.width, len(pivots.at)):
            # a pair asks for scores from the band's foot, or its last one so far, to the band's top
            foot = np.maximum(np.maximum(best.floor, -NORM_LIMIT) * 100, low * score) / 100
            least, most = np.full(len(block.row), np.inf), np.full(len(block.row), -np.inf)
            np.minimum.at(least, owner, foot)
            np.maximum.at(most, owner, high * score / 100)
            for at in range(0, len(having), SLICE):
                some = having[at : at + SLICE]
                some, mask = block.survivors(d, some, least[some], most[some])
                if not len(some):
                    continue
                mask &= block.label[some, None] != label
                exact = block.scores(v, some)
                count = first[some + 1] - first[some]
                for k in range(int(count.max())):
                    ok = np.flatnonzero(count > k)
                    pair = order[first[some[ok]] + k]
                    s, p = exact[ok], score[pair, None]
                    a, j = np.nonzero(mask[ok] & (low * p <= 100 * s) & (100 * s <= high * p) & (s >= best.floor[pair, None]))
                    if len(a):
                        best.add(slot=pair[a], score=s[a, j], none=none[j], id=ident[j], row=row[j])
        h, which = best.held, best.held["slot"]
        anchor = owner[which]
        ids, no_id = ids_of(pairs["positive_id"].combine_chunks())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block.id[anchor], mask=block.no_id[anchor]),
                pa.array(ids[which], mask=no_id[which]),
                pa.array(h["id"], mask=h["none"]),
                pa.array(score[which]),
                pa.array(h["score"]),
                pa.array(block.row[anchor]),
                pa.array(pairs["positive_row"].to_numpy()[which]),
                pa.array(h["row"]),
            ],
            names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score", "a", "p", "n"],
        )

    found = table.drop("near", "far").mapInArrow(lean(searched), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long, a long, p long, n long")
    w = Window.partitionBy("a", "p").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "n")
    kept = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= many)
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors; null counts as false. Repeated rows are rows of their
    own (a copy of an anchor may be its positive); a null id comes last among equal scores. Vectors of
    different lengths count as having zeros behind. Extra columns are ignored, an empty table gives no
    rows. A squared norm (in parts of SCALE) of 2^56 or more is an error, since scores would leave
    the range of a long.
    """
    spark = rows.sparkSession
    full = whole_vectors(rows.withColumn("_is_anchor", F.coalesce(anchor, F.lit(False))), embedding, label)
    full = full.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col("_is_anchor").alias("anchor"), "x")
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    longest, width = full.agg(F.coalesce(F.max(norm2), F.lit(0.0)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if longest >= NORM_LIMIT:
        raise ValueError("vectors are too long: scores would not be longs")
    sample = [r["x"] for r in hash_sample(full.select("x"), PIVOT_SAMPLE).collect()]
    pivots = Pivots(sorted(sample), int(longest), width)
    table = written(pivot_table(full, width, pivots), "pivots")
    size = max(1, min(BLOCK, BLOCK_BYTES // (4 * width + 64)))
    held = ranked(table.where("anchor").select("row", "id", "label", "v"), [], ["row"], "place")
    held = written(held.withColumn("block", F.floor(F.col("place") / size)), "anchors")
    blocks = held.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    path = f"{shared_dir(spark)}/conceptloom/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for k in range(blocks):
        anchors = held.where(F.col("block") == k).orderBy("place").select("row", "id", "label", "v").toArrow()  # `size` rows at most
        found = positives_of(table, anchors, pivots, positives).toArrow()  # `positives` for each of them at most
        negatives_of(table, anchors, found, pivots, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
