"""Search for names by words, over an inverted index.

The index has a row a word and name. A text's words are probed from the rarest on: a name that holds
none of a text's first words can share no more than the rest with it, so probing ends as soon as that
is less than the best name shares. Words that very many names hold are probed last, if at all, and their
rows are dealt by a salt as well. Names that share one word only are looked up by word and length, of which the
index keeps the first line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import alnum, folded, tokens
from ..session import broadcast_if_small, cut_lineage
from .concepts import name_index

#: Rows of a word in one part of the index.
PART_ROWS = 50_000


class WordIndex:
    """Names (cui, lat, str, line_no) by their words of three or more letters and digits; English ones count.

    words: the words (word) that will be asked for, if they are known beforehand; others then get no rows.
    """

    def __init__(self, names: DataFrame, part_rows: int | None = None, words: DataFrame | None = None):
        part_rows = PART_ROWS if part_rows is None else part_rows
        named = names.where("lat = 'ENG'").select("line_no", "cui", F.length(alnum(F.col("str"))).alias("size"), tokens(F.col("str")).alias("words")).where(F.size("words") > 0)
        self.names = cut_lineage(named, "names")
        rows = self.names.select("line_no", "size", F.explode("words").alias("word"))
        if words is not None:
            rows = rows.join(broadcast_if_small(words.select("word").distinct(), "asked-words"), "word", "left_semi")
        self.frequency = cut_lineage(rows.groupBy("word").agg(F.count("*").alias("df")), "frequency")
        heavy = self.frequency.where(F.col("df") > part_rows)
        self.parts = -(-(heavy.agg(F.max("df")).first()[0] or 0) // part_rows)
        rows = rows.join(broadcast_if_small(heavy.select("word", F.lit(True).alias("heavy")), "heavy"), "word", "left")
        rows = rows.withColumn("part", F.when(F.col("heavy"), F.pmod(F.xxhash64("line_no"), F.lit(max(1, self.parts)))).otherwise(0))
        self.rows = cut_lineage(rows.select("word", "part", "line_no", "size"), "postings")
        self.heavy = heavy.select("word")
        self.first_lines = cut_lineage(self.rows.groupBy("word", "size").agg(F.min("line_no").alias("line_no")), "first-lines")


def words_of(texts: DataFrame) -> DataFrame:
    """word: the words of texts, as an index knows them."""
    return texts.select(F.explode(tokens(F.col("text"))).alias("word")).distinct()


def search_words(texts: DataFrame, index: WordIndex) -> DataFrame:
    """id, cui, line_no, shared: of the names that share a word with a text the best. texts: id, text.

    Names go by words shared, then by nearness of length (in letters and digits), then by line. Texts
    without a word of three letters, or whose words no name holds, have none. Rows that share an id are searched each.
    """
    asked = texts.select("id", F.length(alnum(F.col("text"))).alias("length"), F.array_sort(tokens(F.col("text"))).alias("words")).where(F.size("words") > 0)
    asked = cut_lineage(asked, "asked")
    # texts with the same words are one question
    sets = broadcast_if_small(cut_lineage(asked.select("words").distinct().withColumn("set", F.monotonically_increasing_id()), "sets"), "sets")
    probes = sets.select("set", F.explode("words").alias("word")).join(index.frequency, "word")
    nth = Window.partitionBy("set").orderBy("df", "word")
    probes = probes.withColumn("nth", F.row_number().over(nth)).withColumn("many", F.count("*").over(Window.partitionBy("set")))
    probes = probes.join(broadcast_if_small(index.heavy.withColumn("heavy", F.lit(True)), "heavy"), "word", "left")
    parts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(max(0, index.parts - 1)))).otherwise(F.array(F.lit(0)))
    probes = cut_lineage(probes.withColumn("part", F.explode(parts)).withColumn("part", F.col("part").cast("long")).drop("heavy", "df"), "probes")
    longest = probes.agg(F.max("many")).first()[0] or 0
    best = cut_lineage(sets.select("set", F.lit(0).alias("shared")).limit(0), "best")
    hits, lo, width = [], 0, 1
    # the words before `lo` have been probed: names without them share many - lo at most
    while longest - lo >= 2:
        open_ = probes.join(best, "set", "left").withColumn("shared", F.coalesce("shared", F.lit(0))).where(F.col("many") - lo >= F.greatest("shared", F.lit(2)))
        now = broadcast_if_small(open_.where((F.col("nth") > lo) & (F.col("nth") <= lo + width)).select("set", "word", "part", "shared"), "now")
        found = now.join(index.rows, ["word", "part"]).select("set", "line_no", "shared").distinct()
        found = found.join(index.names.select("line_no", "size", F.col("words").alias("_words")), "line_no").join(sets, "set")
        found = found.withColumn("_shared", F.size(F.array_intersect("words", "_words"))).where(F.col("_shared") >= F.greatest("shared", F.lit(2)))
        found = cut_lineage(found.groupBy("set", F.col("_shared").alias("shared"), "size").agg(F.min("line_no").alias("line_no")), "hits")
        hits.append(found)
        best = cut_lineage(best.unionByName(found.select("set", "shared")).groupBy("set").agg(F.max("shared").alias("shared")), "best")
        lo, width = lo + width, 2 * width
    single = probes.select("set", "word").distinct().join(best, "set", "left_anti").join(index.first_lines, "word").groupBy("set", "size").agg(F.min("line_no").alias("line_no"))
    rows = single.select("set", F.lit(1).alias("shared"), "size", "line_no")
    if hits:
        rows = rows.unionByName(reduce(DataFrame.unionByName, hits).join(best, ["set", "shared"], "left_semi"))
    rows = asked.join(sets, "words").join(rows, "set")
    rows = rows.groupBy("id", "length", "set").agg(F.min(F.struct(F.abs(F.col("size") - F.col("length")).alias("apart"), "line_no", "shared")).alias("x"))
    return rows.select("id", "x.line_no", "x.shared").join(index.names.select("line_no", "cui"), "line_no").select("id", "cui", "line_no", "shared")


def link_by_search(texts: DataFrame, atoms: DataFrame) -> DataFrame:
    """text, cui, method of what has one: the exact name, then the search by words. texts: text, distinct."""
    rows = texts.withColumn("name", folded(F.col("text"))).where("name <> ''")
    seen = cut_lineage(rows.join(name_index(atoms), "name", "left").select("text", "cui"), "texts-by-name")
    rest = seen.where("cui is null").select(F.col("text").alias("id"), "text")
    near = search_words(rest, WordIndex(atoms, words=words_of(rest))).select(F.col("id").alias("text"), F.col("cui").alias("near"))
    method = F.when(F.col("cui").isNotNull(), "exact_match").otherwise("semantic_containment")
    return seen.join(near, "text", "left").select("text", F.coalesce("cui", "near").alias("cui"), method.alias("method")).where("cui is not null")
