"""Quality rules with an n-gram perplexity band.

The language model is a modified Kneser-Ney model over the characters of a text,
one a language; words are parted by one mark, and n-grams reach over it, so the order
of words counts. Spark counts the corpus: each task counts its distinct words and
its distinct joints (the last symbols of a word and the first ones of the next), whose
sums give the n-gram counts. Continuation counts, discounts and back-off weights
follow by grouping and joining n-gram tables. The model is kept as arrays sorted
by a 64-bit hash of language and n-gram. A word of any length is counted and scored whole;
where Spark counts a long one's n-grams it looks at stretches of PIECE symbols and the ones before them.

Each language has a second such model, over the kinds of the same symbols (letters of
either case, digits, each ASCII mark by itself, other marks), so marks in unusual places
count whatever letters are around them. Both are counted, smoothed and kept alike.

A document's nats a word in each model are held against its language's band for
that model, which lies around the median; for kinds it is a little wider in short texts. Its width is in units of the
deviation that a text of so many words has. All statistics cover all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, chunks, lean, mix, raw_texts, row_keys, spare_names, without_rows, Words, written

ORDER, PIECE = 4, 32
#: Marks before a text and between words. A joint has REACH symbols of either word.
START, GAP, REACH = "\x02", "\x03", 2
#: The model is broadcast up to so many entries of 12 bytes; a larger one is joined instead. Both give the same sums.
BROADCAST_ENTRIES = 6_000_000
#: Decimals of a document's log probability, beyond which the order of sums shows.
DECIMALS = 6
#: The bands: so many deviations, a deviation of at least FLOOR nats a word.
DEVIATIONS, FLOOR = 6.0, 0.02
#: Nats of kinds by which a text of any length may be off, for a few odd words such as an address or a number.
SPARE = 12.0
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text looked at together, words of a language whose scores are kept, words and joints counted before they go out.
_CHUNK, _DISTINCT, _COUNTED = 1 << 20, 120_000, 300_000


class _Kinds(dict):
    """Of each code point the kind of its symbol; marks of START and GAP are their own."""

    def __missing__(self, c: int) -> str:
        category = unicodedata.category(chr(c))
        self[c] = "A" if category == "Lu" else "a" if category[0] == "L" else "0" if category == "Nd" else chr(c) if c < 128 else "?"
        return self[c]


_KINDS, _RUN = _Kinds(), re.compile("([Aa0]{2})[Aa0]+")
#: Behind a language's name: its model of kinds.
OF_KINDS = "\x04"


def kinds(text: str) -> str:
    """The kinds of a text's symbols; of letters and digits in a row the first two count, so that neither a word's length nor a long number does."""
    return _RUN.sub(r"\1", text.translate(_KINDS))


def kinds_of(texts: list[str]) -> list[str]:
    """The kinds of texts without line breaks, all at once."""
    return kinds("\n".join(texts)).split("\n") if texts else []


def pieces(word: str) -> list[str]:
    """The parts of a word whose symbols are predicted apart from each other: one, whatever its length."""
    return [word]


def _stretches(w: Column) -> Column:
    """Of symbols w stretches of PIECE, each with ORDER - 1 symbols more behind it, so every n-gram lies in one and its last symbol is predicted once."""
    return F.when(F.length(w) <= PIECE + ORDER - 1, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{1,{PIECE + ORDER - 1}}})).{{1,{PIECE}}}"), F.lit(1)))


class _Numbers(dict):
    """Of the first or last bytes of ASCII words the number of their beginning or ending."""

    def __init__(self, number):
        super().__init__()
        self.number = number

    def __missing__(self, part: bytes) -> int:
        self[part] = self.number(part.decode())
        return self[part]


class Ends:
    """Numbers of word beginnings and endings, as they meet in joints. The first ending is that of a text's start."""

    def __init__(self):
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {START: 0}
        self.first, self.last = _Numbers(self._head), _Numbers(self._tail)

    def _head(self, x: str) -> int:
        return self.heads.setdefault((x[:REACH] + GAP)[:REACH], len(self.heads))

    def _tail(self, x: str) -> int:
        return self.tails.setdefault((GAP + x[-REACH:])[-REACH:] + GAP, len(self.tails))

    def describe(self, words: list[bytes]) -> dict[str, np.ndarray]:
        first, last = self.first, self.last
        head = [first[w[:REACH]] if w.isascii() else self._head(w.decode("utf-8", "replace")) for w in words]
        tail = [last[w[-REACH:]] if w.isascii() else self._tail(w.decode("utf-8", "replace")) for w in words]
        return {"head": np.array(head, np.int64), "tail": np.array(tail, np.int64)}

    @staticmethod
    def joints(table: Words, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each word its joint with the word before it, as tail * 2^32 + head."""
        tail = np.zeros(len(ids), np.int64)
        if len(ids):
            tail[1:] = table.columns["tail"][ids[:-1]]
            firsts = ends[:-1]
            tail[firsts[firsts < len(ids)]] = 0
        return (tail << 32) + (table.columns["head"][ids] if len(ids) else tail)

    def strings(self, joints: np.ndarray) -> list[str]:
        heads, tails = list(self.heads), list(self.tails)
        return [tails[j >> 32] + heads[j & 0xFFFFFFFF] for j in joints.tolist()]

    def kinds(self, joints: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The kinds of joints, each once, and of each joint its place among them."""
        of = [kinds_of(list(x)) for x in (self.tails, self.heads)]
        names = [list(dict.fromkeys(x)) for x in of]
        tail, head = (np.array(list(map({v: k for k, v in enumerate(n)}.get, x)), np.int64) for x, n in zip(of, names, strict=True))
        distinct, at = np.unique((tail[joints >> 32] << 32) + head[joints & 0xFFFFFFFF], return_inverse=True)
        return [names[0][j >> 32] + names[1][j & 0xFFFFFFFF] for j in distinct.tolist()], at


def count_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, joint (boolean), word, n: every word and every joint of every text, counted. A null language is ''."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Ends, Words, list]] = {}

        def rows(name: str) -> Iterator[pa.RecordBatch]:
            ends, table, (words, joints, n) = held[name]
            seen = np.flatnonzero(words[: len(table)])
            every = list(table)
            whole = [every[k].decode("utf-8", "replace") for k in seen.tolist()]
            for joint, part, values in ((False, whole, words[seen].tolist()), (True, ends.strings(joints), n.tolist())):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array([joint] * len(part), pa.bool_()), pa.array(part, pa.string()), pa.array(values, pa.int64())], names=["lang", "joint", "word", "n"])

        for batch in chunks(batches, most=_CHUNK):
            langs, texts = batch.column(1).to_pylist(), raw_texts(batch)
            for name in dict.fromkeys(langs):
                if name not in held:
                    ends = Ends()
                    held[name] = ends, Words(ends.describe, 1 << 62), [np.zeros(0, np.int64)] * 3
                ends, table, (words, joints, n) = held[name]
                ids, bounds = table.indices([t.split() for t, x in zip(texts, langs, strict=True) if x == name])
                now = np.bincount(ids, minlength=len(table))
                now[: len(words)] += words
                fresh, many = np.unique(Ends.joints(table, ids, bounds), return_counts=True)
                joints, at = np.unique(np.concatenate([joints, fresh]), return_inverse=True)
                held[name][2][:] = now, joints, np.bincount(at, np.concatenate([n, many]), len(joints)).astype(np.int64)
            if sum(len(table) + len(parts[1]) for _, table, parts in held.values()) > _COUNTED or len(held) > 64:
                for name in held:
                    yield from rows(name)
                held.clear()
        for name in held:
            yield from rows(name)

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    return rows.mapInArrow(lean(counted), "lang string, joint boolean, word string, n long").groupBy("lang", "joint", "word").agg(F.sum("n").alias("n"))


def count_kinds(words: DataFrame) -> DataFrame:
    """The rows of count_words with the kinds of their symbols, under their language's model of kinds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            langs, joints, words, n = (batch.column(k).to_pylist() for k in range(4))
            for lang, joint, word, k in zip(langs, joints, kinds_of(words), n, strict=True):
                held[lang + OF_KINDS, joint, word] += k
            if len(held) > _COUNTED:
                yield rows(held)
                held.clear()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        of = [pa.array([x[k] for x in held], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
        return pa.RecordBatch.from_arrays([*of, pa.array(list(held.values()), pa.int64())], names=["lang", "joint", "word", "n"])

    return words.select("lang", "joint", "word", "n").mapInArrow(lean(counted), "lang string, joint boolean, word string, n long").groupBy("lang", "joint", "word").agg(F.sum("n").alias("n"))


def _padded(units: DataFrame) -> DataFrame:
    """units with w, the symbols, and p, the first place that is predicted: a word's after its joint, a joint's after its mark."""
    first = F.when(F.col("joint") & F.col("word").startswith(START), 2).otherwise(REACH + 2)
    return units.withColumn("w", F.when(F.col("joint"), F.col("word")).otherwise(F.concat(F.lit(GAP), "word", F.lit(GAP)))).withColumn("first", first)


def count_grams(words: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: for each predicted symbol of a word or a joint the n-gram that ends there, shorter at a text's start."""

    def ending(w: Column) -> Column:
        places = F.when(F.length(w) >= F.col("first"), F.sequence(F.col("first"), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.substring(w, F.greatest(p - (order - 1), F.lit(1)), F.least(p, F.lit(order))))

    w = F.col("w")
    grams = F.when(F.length(w) <= PIECE + ORDER - 1, ending(w)).otherwise(F.flatten(F.transform(_stretches(w), ending)))
    return _padded(words).select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, context (boolean), value: log probabilities of n-grams and log back-off weights of contexts.

    The empty context's value holds the weight of an unknown symbol.
    """
    grams = grams.withColumn("size", F.length("gram"))
    tables = {order: grams.where(F.col("size") == order).select("lang", "gram", F.col("n").alias("c"))}
    for n in range(order - 1, 0, -1):
        follow = tables[n + 1].select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
        tables[n] = follow.unionByName(grams.where((F.col("size") == n) & F.col("gram").startswith(START)).select("lang", "gram", F.col("n").alias("c")))
    out, lower = [], None
    for n in range(1, order + 1):
        table = tables[n].withColumn("h", F.expr(f"substring(gram, 1, {n - 1})"))
        of = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        bounded = lambda x, most: F.when(x.isNull(), most / 2).otherwise(F.greatest(F.lit(0.05), F.least(x, F.lit(most - 0.05))))  # noqa: E731  null where counts of counts are lacking
        ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
        y = F.when(F.col("n1") > 0, y)
        discounts = table.groupBy("lang").agg(*of).select(
            "lang",
            bounded(1 - 2 * y * ratio("n2", "n1"), 1.0).alias("d1"),
            bounded(2 - 3 * y * ratio("n3", "n2"), 2.0).alias("d2"),
            bounded(3 - 4 * y * ratio("n4", "n3"), 3.0).alias("d3"),
        )
        table = table.join(checked_broadcast(discounts, "discounts"), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        table = written(table, "discounted")
        contexts = written(table.groupBy("lang", "h").agg(F.sum("c").alias("all"), F.sum("d").alias("freed"), F.count("*").alias("v")), "contexts")
        table = table.join(contexts, ["lang", "h"]).withColumn("weight", F.col("freed") / F.col("all"))
        if n == 1:
            base = 1.0 / (F.col("v") + 1)
        else:
            below = lower.select("lang", F.col("gram").alias("s"), F.col("p").alias("q"))
            table = table.withColumn("s", F.expr("substring(gram, 2)")).join(below, ["lang", "s"])
            base = F.col("q")
        lower = table.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("all") + F.col("weight") * base).alias("p"))
        lower = written(lower, "grams")
        out.append(lower.select("lang", "gram", F.lit(False).alias("context"), F.log("p").cast("float").alias("value")))
        unknown = F.log(F.col("freed") / F.col("all")) - (F.log(F.col("v") + 1) if n == 1 else F.lit(0.0))
        out.append(contexts.select("lang", F.col("h").alias("gram"), F.lit(True).alias("context"), unknown.cast("float").alias("value")))
    return reduce(DataFrame.unionByName, out)


def gram_hash(codes: np.ndarray, at: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of the `size` symbols before each position `at` (exclusive)."""
    h = np.full(len(at), seed + np.uint64(size), np.uint64)
    for k in range(size, 0, -1):
        h = (h ^ codes[at - k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return mix(h)


def lang_seed(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()) >> 1)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class HashArrays:
    """The models: hashes of n-grams and of contexts in order, each with its value."""

    def __init__(self, model: DataFrame | None = None):
        self.parts, self.unknown = {}, {}

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, grams = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                sizes = np.fromiter(map(len, grams), np.int64, len(grams))
                codes, key = _codes(grams), np.zeros(len(grams), np.uint64)
                ends = np.cumsum(sizes)
                for lang in set(langs):
                    for size in range(1, ORDER + 1):
                        mine = np.flatnonzero((langs == lang) & (sizes == size))
                        key[mine] = gram_hash(codes, ends[mine], size, lang_seed(lang))
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(key.view(np.int64)), batch.column(3)], names=["context", "key", "value"])

        if model is None:
            self.parts = {flag: (np.zeros(0, np.uint64), np.zeros(0, np.float32)) for flag in (False, True)}
            return
        self.unknown = {r["lang"]: float(r["value"]) for r in model.where("context and gram = ''").select("lang", "value").collect()}  # one a language
        rows = model.where("gram <> ''").select("lang", "gram", "context", "value").mapInArrow(lean(hashed), "context boolean, key long, value float").toArrow()
        context, key, value = rows["context"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()
        for flag in (False, True):
            mine = np.flatnonzero(context == flag)
            mine = mine[np.argsort(key[mine])]
            self.parts[flag] = key[mine], value[mine].astype(np.float32)

    def get(self, context: bool, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value)"""
        keys, values = self.parts[context]
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found = keys[at] == key
        return found, np.where(found, values[at], np.float32(0))

    def score(self, lang: str, texts: list[str], first: np.ndarray) -> np.ndarray:
        """Log probability of each string's symbols from its place `first` (counted from 0) on."""
        codes, seed = _codes(texts), lang_seed(lang)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(codes))
        own = np.repeat(np.arange(len(texts)), sizes)
        keep = at - begin >= np.repeat(first, sizes)
        at, own, depth = at[keep], own[keep], (at - begin)[keep] + 1
        total = np.zeros(len(at))
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            now = todo[depth[todo] >= n]
            found, value = self.get(False, gram_hash(codes, at[now] + 1, n, seed))
            total[now[found]] += value[found]
            miss = now[~found]
            if n > 1:
                total[miss] += self.get(True, gram_hash(codes, at[miss], n - 1, seed))[1]
            else:
                total[miss] += self.unknown.get(lang, -20.0)
            todo = np.concatenate([todo[depth[todo] < n], miss])
        return np.bincount(own, total, len(texts))

    def describe(self, lang: str, words: list[bytes]) -> dict[str, np.ndarray]:
        """Log probability of words without their joints, that of their kinds, and number of symbols."""
        texts = [f"{GAP}{w.decode('utf-8', 'replace')}{GAP}" for w in words]
        symbols = np.fromiter(map(len, texts), np.int64, len(texts)) - 1
        found = self.score(lang, texts, np.full(len(texts), REACH + 1))
        shapes = kinds_of(texts)
        number = {x: k for k, x in enumerate(dict.fromkeys(shapes))}
        alike = self.score(lang + OF_KINDS, list(number), np.full(len(number), REACH + 1))
        shaped = alike[np.array(list(map(number.get, shapes)), np.int64)]
        return {"logp": found, "shaped": shaped, "symbols": symbols}

    def joints(self, lang: str, ends: Ends, joints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of the first symbols of words after the words before them, and that of their kinds."""
        distinct, at = np.unique(joints, return_inverse=True)
        first = lambda texts: np.array([1 if x[0] == START else REACH + 1 for x in texts], np.int64)
        texts, (shapes, of) = ends.strings(distinct), ends.kinds(distinct)
        return self.score(lang, texts, first(texts))[at], self.score(lang + OF_KINDS, shapes, first(shapes))[of][at]


def base_counts(text: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    bare = text.translate(None, SPACES)
    continuing = len(bare) - len(bare.translate(None, bytes(range(0x80, 0xC0)))) if not bare.isascii() else 0
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACES)]
    repeats = 0
    n = len(ids) - REPEAT_WINDOW + 1
    if n > 1 and len(set(words)) < len(words):
        w = ids.astype(np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(REPEAT_WINDOW):
            h = (h ^ w[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        ordered = np.sort(h)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            twice = np.isin(h, again)
            edge = np.zeros(len(ids) + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + REPEAT_WINDOW, -1)
            repeats = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(bare) - continuing, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


_COLUMNS = ("_words", "_chars", "_symbols", "_dup", "_repeat", "_predicted")


def measure(docs: DataFrame, model: HashArrays, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the base counts (`_words` ...), `_predicted` symbols, their log probability `_logp` and that of their kinds, `_shaped`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: dict[str, tuple[Ends, Words]] = {}
        for batch in chunks(batches, "_text", _CHUNK):
            texts = raw_texts(batch, "_text")
            langs = batch.column(batch.schema.get_field_index("_lang")).to_pylist()
            rows, logp, shaped = np.zeros((len(texts), 6), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            for name in dict.fromkeys(langs):
                if name not in caches:
                    if len(caches) >= 8:
                        caches.clear()
                    ends = Ends()
                    caches[name] = ends, Words(lambda words, name=name, ends=ends: shared.value.describe(name, words) | ends.describe(words), _DISTINCT)
                mine = [k for k, x in enumerate(langs) if x == name]
                lists = [texts[k].split() for k in mine]
                halves, table = caches[name]
                ids, ends = table.indices(lists)
                between, alike = shared.value.joints(name, halves, Ends.joints(table, ids, ends)) if len(ids) else (np.zeros(0), np.zeros(0))
                for j, k in enumerate(mine):
                    own = ids[ends[j] : ends[j + 1]]
                    rows[k, 0] = len(own)
                    rows[k, 1:5] = base_counts(texts[k], lists[j], own)
                    if len(own):
                        rows[k, 5] = table.columns["symbols"][own].sum()
                        logp[k] = table.columns["logp"][own].sum() + between[ends[j] : ends[j + 1]].sum()
                        shaped[k] = table.columns["shaped"][own].sum() + alike[ends[j] : ends[j + 1]].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(rows[:, c]) for c in range(6)), pa.array(np.round(logp, DECIMALS)), pa.array(np.round(shaped, DECIMALS))], names=[*kept, *_COLUMNS, "_logp", "_shaped"])

    rows = docs.select(*kept, F.col(text).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} long" for c in _COLUMNS), "_logp double", "_shaped double"])
    return rows.mapInArrow(lean(measured), schema)


def _kinds_only():
    return F.col("lang").endswith(OF_KINDS)


def measure_by_join(docs: DataFrame, words: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """As measure(), for a model of any size: words and joints are scored by joins with the n-gram tables, documents by joins with these.

    The models of kinds are sent out all the same: there are at most some 40 kinds, so 40 ** ORDER n-grams a language, of which text has some thousands.
    """
    base = measure(docs.withColumn("_row", F.monotonically_increasing_id()), HashArrays(model.where(_kinds_only())), text, lang)
    model = model.where(~_kinds_only())
    base = written(base.withColumn("_lang", F.coalesce(F.col(lang).cast("string"), F.lit(""))), "measured")
    places = F.when(F.length("w") >= F.col("first"), F.sequence(F.col("first"), F.length("w")))
    tries = _padded(words).select("lang", "joint", "word", "first", F.posexplode(_stretches(F.col("w"))).alias("part", "w"))
    tries = tries.select("lang", "joint", "word", "part", "w", F.explode(places).alias("p"))
    tries = tries.select("lang", "joint", "word", "part", "p", "w", F.explode(F.sequence(F.lit(1), F.least(F.col("p"), F.lit(order)))).alias("k"))
    tries = tries.select("lang", "joint", "word", "part", "p", "k", F.expr("substring(w, p - k + 1, k)").alias("g"), F.expr("substring(w, p - k + 1, k - 1)").alias("h"))
    known = model.where("not context").select("lang", F.col("gram").alias("g"), F.col("value").alias("logp"))
    weights = model.where("context").select("lang", F.col("gram").alias("h"), F.col("value").alias("bow"))
    tries = tries.join(known, ["lang", "g"], "left").join(weights, ["lang", "h"], "left")
    # the longest known n-gram counts, with the weights of all longer contexts; weights of none: the unknown symbol
    places = tries.groupBy("lang", "joint", "word", "part", "p").agg(F.max(F.when(F.col("logp").isNotNull(), F.struct("k", "logp"))).alias("best"), F.collect_list(F.struct("k", F.coalesce("bow", F.lit(0.0)).alias("bow"))).alias("all"))
    value = F.coalesce(F.col("best.logp").cast("double"), F.lit(0.0)) + F.aggregate(F.filter("all", lambda x: x["k"] > F.coalesce(F.col("best.k"), F.lit(0))), F.lit(0.0), lambda s, x: s + x["bow"])
    scores = places.groupBy("lang", "joint", "word").agg(F.sum(value).alias("logp"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = Ends()
        table = Words(ends.describe, _DISTINCT)
        for batch in chunks(batches, "_text", _CHUNK):
            for row, name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch, "_text"), strict=True):
                cut: Counter = Counter()
                split = raw.split()
                for word, n in Counter(split).items():
                    cut[False, word.decode("utf-8", "replace")] += n
                ids, bounds = table.indices([split])
                found, n = np.unique(Ends.joints(table, ids, bounds), return_counts=True)
                cut.update({(True, x): k for x, k in zip(ends.strings(found), n.tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(cut), pa.int64()), pa.array([name] * len(cut), pa.string()), pa.array([x[0] for x in cut], pa.bool_()), pa.array([x[1] for x in cut], pa.string()), pa.array(list(cut.values()), pa.int64())], names=["_row", "lang", "joint", "word", "n"])

    used = base.select("_row", "_lang", F.col(text).alias("_text")).mapInArrow(lean(spread), "_row long, lang string, joint boolean, word string, n long")
    total = used.join(scores, ["lang", "joint", "word"]).groupBy("_row").agg(F.round(F.sum(F.col("n") * F.col("logp")), DECIMALS).alias("_found"))
    return base.join(total, "_row", "left").withColumn("_logp", F.coalesce("_found", F.lit(0.0))).drop("_row", "_found", "_lang")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", broadcast_entries: int = BROADCAST_ENTRIES, narrow: bool = False) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, nats (a symbol), base_failed, side (of the band: -1, 0, 1) and kept, all prefixed by `_`.

    Texts without a word have no perplexity and fail the base rules. A null
    language is a language of its own. A language's bands rest on those of its
    documents that pass the base rules.
    """
    words = written(count_words(docs, text, lang), "words")
    both = words.unionByName(count_kinds(words))
    model = written(kneser_ney(written(count_grams(both), "counts")), "model")
    if model.where(~_kinds_only()).count() <= broadcast_entries:
        rows = measure(docs, HashArrays(model), text, lang)
    else:
        rows = measure_by_join(docs, words, model, text, lang)
    failed = (F.col("_words") < MIN_WORDS) | (100 * F.col("_repeat") > REPEAT_PERCENT * F.col("_words"))
    rows = rows.drop(text) if narrow else rows
    rows = written(rows.withColumn("_base_failed", failed).withColumn("_nats", F.when(F.col("_predicted") > 0, -F.col("_logp") / F.col("_predicted"))), "measured")
    name = F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_band")
    units = {"_spelling": -F.col("_logp") / F.nullif("_words", F.lit(0)), "_kinds": -F.col("_shaped") / F.nullif("_words", F.lit(0))}
    seen = rows.where("not _base_failed").select(name, "_words", *[F.round(x * 1000).cast("long").alias(c) for c, x in units.items()])
    middle = seen.groupBy("_band").agg(*[F.percentile(c, 0.5).alias(f"{c}_mid") for c in units])
    # a mean over n words deviates by 1 / sqrt(n) of what one word does
    one = lambda c: F.round(F.abs(F.col(c) - F.col(f"{c}_mid")) * F.sqrt("_words"))
    spread = seen.join(checked_broadcast(middle, "middle"), "_band").groupBy("_band").agg(*[F.first(f"{c}_mid").alias(f"{c}_mid") for c in units], *[F.percentile(one(c), 0.5).alias(f"{c}_mad") for c in units])
    spare = {"_spelling": F.lit(0.0), "_kinds": F.try_divide(F.lit(SPARE), F.col("_words"))}
    near = lambda c: DEVIATIONS * F.greatest(1.4826 * F.col(f"{c}_mad") / 1000 / F.sqrt("_words"), F.lit(FLOOR)) + spare[c]
    off = {c: x - F.col(f"{c}_mid") / 1000 for c, x in units.items()}
    beyond = [F.when(F.abs(x) > near(c), F.signum(x)).when(x.isNotNull() & near(c).isNotNull(), 0.0) for c, x in off.items()]
    side = F.when(beyond[0] != 0, beyond[0]).otherwise(beyond[1]).cast("int")
    out = rows.withColumn("_band", name).join(checked_broadcast(spread, "bands"), "_band", "left").withColumn("_side", side)
    return out.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_side") == 0, F.lit(False))).drop("_band")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nats and side of every row.

    side tells where a text lies: -1 below a band (too predictable), 1 above (too surprising),
    0 within, null without a word or a band. Null and empty texts have no words and fail
    the base rules; repeated rows are judged and counted each; a null language is one
    of its own; other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    if narrow.isEmpty():
        return narrow.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(0.0).alias("nats"), F.lit(0).alias("side"))
    rows = judged(narrow, narrow=True)
    return rows.select("doc_id", F.col("_words").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"), F.col("_repeat").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_nats").alias("nats"), F.col("_side").alias("side"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever the names of these.

    Nulls, empties, repeats and an empty table are treated as in quality_rules. Rows are judged without
    their texts being written again: rejected ones are known by two hashes of all
    columns. Rows that a bitmap of these clears pass; the few others are told apart by a join.
    """
    if docs.isEmpty():
        return docs
    (a, b), (first, second) = spare_names(docs, "_a", "_b"), row_keys(docs)
    keyed = docs.withColumn(a, first).withColumn(b, second)
    rows = judged(keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), "text", "lang"), narrow=True)
    rejected = written(rows.where("not _kept").select(F.col("a").alias(a), F.col("b").alias(b)).distinct().withColumn("keep", F.lit(False)), "rejected")
    return without_rows(keyed, rejected, [a, b]).select(*[F.col(f"`{c}`") for c in docs.columns])
