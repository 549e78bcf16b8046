"""Helpers that the training-data operators share.

Conventions: a null text counts as empty; extra columns are ignored; repeated
rows are kept as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20
WORD_CACHE = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="conceptloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables after which the driver's garbage goes: plans, broadcasts and shuffle files of earlier ones.
_TIDY_EVERY = 6
_written = count(1)


def tidy(spark: SparkSession) -> None:
    """Gives back what the driver no longer uses; Spark drops the shuffle files and broadcasts of plans when these are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release()


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back."""
    if next(_written) % _TIDY_EVERY == 0:
        tidy(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/conceptloom/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that go to every executor; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, tag: str) -> DataFrame:
    """df, written, and marked to be broadcast if it has BROADCAST_ROWS rows or fewer."""
    df = written(df, tag)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df has not, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(df: DataFrame) -> tuple:
    """Two 64-bit hashes of all columns of a row; rows with equal keys are the same."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def doc_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_sample(rows: DataFrame, most: int, per: str | None = None) -> DataFrame:
    """The `most` distinct rows with the smallest hashes, of each value of `per` if given. Equal rows count as one.

    Hashes alone are sorted, each task's smallest first; texts are read once more, and only those
    of the sample move.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    if per is None:
        chosen = hashed.select("_hash").distinct().orderBy("_hash").limit(most)
        return hashed.join(F.broadcast(chosen), "_hash", "left_semi").dropDuplicates(["_hash"]).drop("_hash")
    group = F.coalesce(F.col(per).cast("string"), F.lit(""))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for name in set(names):
                held[name] = np.unique(np.concatenate([held.get(name, values[:0]), values[names == name]]))[:most]
        for name, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values)], names=["g", "_hash"])

    narrow = hashed.select(group.alias("g"), "_hash").mapInArrow(lean(smallest), "g string, _hash long")
    # a second step on sub-groups keeps what meets in one task small, whatever the number of tasks
    for keys in (["g", F.pmod(F.col("_hash"), F.lit(64))], ["g"]):
        narrow = narrow.distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).where(F.col("_rank") <= most).drop("_rank")
    return hashed.join(F.broadcast(narrow.select("_hash")), "_hash", "left_semi").dropDuplicates(["_hash"]).drop("_hash")


def release() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another system's allocator
        pass


#: What a worker keeps from task to task, as long as its tasks ask for it.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What this worker keeps by that name, made if it isn't there; for tasks that lean() is told of."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Gives back what this worker keeps."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # an encoder and its words refer to each other
        release()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, which gives its memory back to the system when it ends: workers live on, idle, and the allocator would keep it.

    keeps: it uses what kept() holds. Any other task gives that back first, so that a later step or query has the memory to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from task(batches)
        release()

    return run


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that none holds much more text than `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of a column, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


class Words(dict):
    """Word bytes to a running index, with arrays of properties that are computed once a new word.

    `describe` gets the list of new words and returns arrays, one value (or row)
    a word. The cache is emptied between chunks when it has grown beyond
    `most` words, which changes no result.
    """

    def __init__(self, describe: Callable[[list[bytes]], dict[str, np.ndarray]], most: int = WORD_CACHE):
        super().__init__()
        self.describe, self.most = describe, most
        self.new: list[bytes] = []
        self.columns: dict[str, np.ndarray] = {}
        self.filled = 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = self.filled + len(self.new)
        self.new.append(word)
        return at

    def indices(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all words of all lists, and the offset of each list (one more at the end)."""
        if len(self) > self.most:
            self.clear()
            self.columns, self.filled = {}, 0
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        look = self.__getitem__
        out = np.fromiter(map(look, chain.from_iterable(lists)), dtype=np.int64, count=int(ends[-1]))
        if self.new:
            fresh = self.describe(self.new)
            for name, values in fresh.items():
                old = self.columns.get(name)
                if old is None or len(old) < self.filled + len(values):
                    grown = np.empty((max(1024, 2 * (self.filled + len(values))), *values.shape[1:]), values.dtype)
                    if old is not None:
                        grown[: self.filled] = old[: self.filled]
                    self.columns[name] = old = grown
                old[self.filled : self.filled + len(values)] = values
            self.filled += len(self.new)
            self.new = []
        return out, ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values in each [ends[i], ends[i+1]); empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0)])
    return total[ends[1:]] - total[ends[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 + seed, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x5851F42D4C957F2D) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, per_bucket: int = 100_000, rows: int | None = None) -> DataFrame:
    """Adds `name`: a gapless number from 0 within each value of `keys`, in order of the md5 of the columns `order`.

    Rows of one key are dealt to sub-buckets, ranges of that md5; the buckets'
    counts, a small table, give each bucket's first number. So a key that holds
    a third of all rows is not one task, and the numbers are the same however many buckets
    there are. `order` should tell rows apart; rows that it doesn't tell apart may swap numbers.
    """
    rows = df.count() if rows is None else rows
    n = max(8, -(-rows // per_bucket))
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in order])
    dealt = df.withColumn("_md5", F.md5(text.cast("binary")))
    dealt = dealt.withColumn("_sub", F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") * n / float(1 << 32)).cast("int"))
    counts = dealt.groupBy(*keys, "_sub").count()
    first = counts.withColumn("_first", F.sum("count").over(Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    w = Window.partitionBy(*keys, "_sub").orderBy("_md5", *order)
    out = dealt.withColumn("_row", F.row_number().over(w)).join(first, [*keys, "_sub"])
    return out.withColumn(name, F.coalesce("_first", F.lit(0)) + F.col("_row") - 1).drop("_sub", "_row", "_first", "_md5")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps over tables in the shared
    folder; each step is a grouped minimum, combined before the shuffle, and a
    join, whose skew Spark splits. Nothing is gathered on the driver but a
    count. Nodes without an edge to another node are not returned.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, tag)
    signature = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        hop = e.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(hop.where("a <> b").distinct(), tag)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == signature:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        signature = now


#: An id filter has at most so many bits (16 MB), whatever the number of ids.
FILTER_BITS = 1 << 27


class IdFilter:
    """A bitmap of hashed ids of fixed greatest size: no id is missed; others may pass, which only costs work."""

    def __init__(self, ids: DataFrame, column: str, raw: bool = False):
        """raw: the ids are hashes already, and their low bits serve."""
        self.raw, n = raw, ids.count()
        self.bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * max(1, n) - 1).bit_length()))
        at = self.bucket(column)
        rows = ids.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
        words = np.zeros(self.bits // 64, np.int64)
        words[rows["w"].to_numpy()] = rows["m"].to_numpy()
        self.words = ids.sparkSession.sparkContext.broadcast(words)

    def bucket(self, column: str):
        if self.raw:
            return F.col(column).bitwiseAND(F.lit(self.bits - 1).cast("long"))
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.bits))

    def keep(self, docs: DataFrame, column: str, others: bool = False, then: Callable | None = None, schema=None) -> DataFrame:
        """The rows of docs whose id is among the ids, and a few more; or just the others, which surely are not.

        then: a function of batches that takes them on in the same worker, to rows of `schema`.
        """
        words, names, (bucket,) = self.words, docs.columns, spare_names(docs, "_bucket")

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = batch.column(batch.num_columns - 1).to_numpy()
                ok = (words.value[b >> 6] >> (b & 63)) & 1 == (0 if others else 1)
                yield batch.select(names).filter(pa.array(ok))

        return docs.withColumn(bucket, self.bucket(column)).mapInArrow(lean(passing if then is None else lambda batches: then(passing(batches))), schema or docs.schema)


def without_rows(docs: DataFrame, special: DataFrame, keys: list[str]) -> DataFrame:
    """docs (with two key columns) without the rows that `special` names with keep = false; of equal rows that it names with keep = true one stays.

    A bitmap clears most rows, which pass where they are; only what it can't clear is joined.
    """
    a, b = keys
    known = IdFilter(special, a, raw=True)
    verdict, each = spare_names(docs, "_keep", "_each")
    doubtful = known.keep(docs, a).join(special.withColumnRenamed("keep", verdict), keys, "left")
    # rows that are not named stay, all of them; the number only tells them apart
    doubtful = doubtful.where(F.coalesce(verdict, F.lit(True))).withColumn(each, F.when(F.col(verdict).isNull(), F.monotonically_increasing_id()))
    doubtful = doubtful.dropDuplicates([a, b, each])
    return known.keep(docs, a, others=True).unionByName(doubtful.select(*[F.col(f"`{c}`") for c in docs.columns]))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
