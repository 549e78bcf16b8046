"""Readers of annotated corpora.

Each reader returns annotations as rows: doc_id, split (null if the format has
none), doc_text, start, end, text and the format's id columns. Offsets are code
points, half open. Files are read by Spark alone, so any store serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def whole_files(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """path, stem, text of each file; line ends as \\n. Decoded from bytes, so that a final line end stays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select("path", name.alias("stem"), F.regexp_replace(F.decode("content", charset), r"\r\n?", "\n").alias("text"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line-separated blocks of a file, as arrays of lines. The files of one path have one kind of line ends."""
    crlf = not spark.read.option("lineSep", "\n").text(path).limit(1).where(F.col("value").endswith("\r")).isEmpty()
    rows = spark.read.option("lineSep", "\n\r\n" if crlf else "\n\n").text(path)
    lines = F.filter(F.split(F.rtrim("value", F.lit("\r")) if crlf else "value", r"\r?\n"), lambda x: F.trim(x) != "")
    return rows.select(lines.alias("lines")).where(F.size("lines") > 0)


def _field(line: Column, k: int) -> Column:
    return F.try_element_at(F.split(line, "\t"), F.lit(k))


def pubtator(spark: SparkSession, path: str, split: str | None = None, last_text: bool = False) -> DataFrame:
    """Title and abstract blocks with six-field annotation lines: doc_id, split, doc_text, start, end, text, entity_type, concept.

    Lines of fewer fields (relations) and lines whose offsets are no numbers go.
    The text is the title and, if there is one, a blank and the abstract. last_text: of several blocks with one id
    the last one's text stands for all.
    """
    mark = lambda letter: rf"^([^|\t]+)\|{letter}\|(.*)$"
    first = lambda letter: F.try_element_at(F.filter("lines", lambda x: x.rlike(mark(letter))), F.lit(1))
    rows = blocks(spark, path).select("lines", first("t").alias("t"), first("a").alias("a")).where("t is not null")
    title, abstract = F.regexp_extract("t", mark("t"), 2), F.coalesce(F.regexp_extract("a", mark("a"), 2), F.lit(""))
    docs = rows.select(F.regexp_extract("t", mark("t"), 1).alias("doc_id"), F.when(abstract != "", F.concat(title, F.lit(" "), abstract)).otherwise(title).alias("doc_text"), "lines")
    if last_text:
        numbered = docs.withColumn("at", F.monotonically_increasing_id())
        docs = numbered.withColumn("doc_text", F.max_by("doc_text", "at").over(Window.partitionBy("doc_id"))).drop("at")
    docs = docs.select("doc_id", "doc_text", F.explode(F.filter("lines", lambda x: x.contains("\t"))).alias("line"))
    docs = docs.where(F.size(F.split("line", "\t")) >= 6)
    out = docs.select("doc_id", F.lit(split).cast("string").alias("split"), "doc_text", _field(F.col("line"), 2).try_cast("int").alias("start"), _field(F.col("line"), 3).try_cast("int").alias("end"), _field(F.col("line"), 4).alias("text"), _field(F.col("line"), 5).alias("entity_type"), _field(F.col("line"), 6).alias("concept"))
    return out.where("start is not null and end is not null")


def pubtator_splits(spark: SparkSession, path: str, lists: dict[str, str]) -> DataFrame:
    """One corpus with lists of ids by split: semantic type is the first T-code of the type list. Ids of no list: unknown."""
    rows = pubtator(spark, path, last_text=True).drop("split").withColumn("semantic_type", F.regexp_extract("entity_type", r"(T\d+)", 1))
    members = None
    for prio, name in enumerate(("train", "dev", "test")):
        if name in lists:
            part = spark.read.text(lists[name]).select(F.trim("value").alias("doc_id"), F.lit(prio).alias("prio"), F.lit(name).alias("split")).where("doc_id <> ''")
            members = part if members is None else members.unionByName(part)
    if members is None:
        return rows.withColumn("split", F.lit("unknown"))
    own = members.groupBy("doc_id").agg(F.min_by("split", "prio").alias("split"))
    return rows.join(own, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def standoff_pairs(spark: SparkSession, texts: str, annotations: str, with_folder: bool = False) -> DataFrame:
    """.txt and .ann files of one stem: `T1<TAB>CODE start end<TAB>mention`. Other rows, and spans out of range, go. with_folder: ids begin with the folder's name."""
    doc_id = (F.concat(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("_"), "stem") if with_folder else F.col("stem")).alias("doc_id")
    docs = whole_files(spark, texts).where(F.col("path").endswith(".txt")).select(doc_id, F.col("text").alias("doc_text"))
    marks = whole_files(spark, annotations).where(F.col("path").endswith(".ann")).select(doc_id, F.explode(F.split("text", "\n")).alias("line"))
    marks = marks.where(F.col("line").startswith("T") & (F.size(F.split("line", "\t")) >= 3))
    info = F.split(_field(F.col("line"), 2), r"\s+")
    marks = marks.where(F.size(info) >= 3).select("doc_id", info[0].alias("code"), info[1].try_cast("int").alias("start"), info[2].try_cast("int").alias("end"), _field(F.col("line"), 3).alias("text"))
    return marks.join(docs, "doc_id").where("start >= 0 and start < end and end <= length(doc_text)").select("doc_id", F.lit(None).cast("string").alias("split"), "doc_text", "start", "end", "text", "code")


def dual_standoff(spark: SparkSession, texts: str, first: str, second: str, charset: str = "ISO-8859-1") -> DataFrame:
    """Texts with two annotation folders (clinical and drug-dictionary ids), merged by span.

    An annotation's info is `id | name | start end`, `id || ... || start end` or
    `CONCEPT_LESS start end`; of `X or Y` the first counts. The mention is what the
    span covers; the first folder's id comes first.
    """
    docs = whole_files(spark, texts, charset).select(F.col("stem").alias("doc_id"), F.col("text").alias("doc_text")).where("trim(doc_text) <> ''")

    def side(path: str, name: str) -> DataFrame:
        rows = whole_files(spark, path, charset).select(F.col("stem").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        info = _field(F.col("line"), 2)
        code = F.when(F.upper(info).rlike(r"CONCEPT[_-]LESS"), "CONCEPT_LESS").otherwise(F.regexp_extract(info, r"^\s*(\d+)", 1))
        span = r"(\d+)\s+(\d+)\s*$"
        # of `id or id | name | span` and `id || name | span` the name is what stands behind the first bars
        called = concept_name(F.trim(F.regexp_extract(info, r"^[^|]*\|{1,2}(.*)$", 1)))
        told = F.struct(code.alias("code"), F.when(info.contains("|"), called).otherwise("").alias("name"), _field(F.col("line"), 1).alias("tag"))
        rows = rows.where(F.size(F.split("line", "\t")) >= 2).select("doc_id", "pos", told.alias("code"), F.regexp_extract(info, span, 1).try_cast("int").alias("start"), F.regexp_extract(info, span, 2).try_cast("int").alias("end"))
        return rows.where("start is not null and code.code <> ''").groupBy("doc_id", "start", "end").agg(F.max_by("code", "pos").alias(name))

    both = side(first, "a").join(side(second, "b"), ["doc_id", "start", "end"], "full_outer").join(docs, "doc_id")
    mention = F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return both.select("doc_id", F.lit(None).cast("string").alias("split"), "doc_text", "start", "end", mention.alias("text"), F.col("a.code").alias("first_id"), F.col("b.code").alias("second_id"), F.coalesce("a.code", "b.code").alias("native_id"), F.coalesce("a.name", F.lit("")).alias("snomed_name"), F.coalesce("a.tag", "b.tag").alias("annotation_id"))


def concept_name(c: Column) -> Column:
    """A concept's name without spans and marks: what stands before the first bar, else what is left after it, else Unknown concept."""
    bar = F.instr(c, "|")
    head = F.trim(F.substring(c, F.lit(1), bar - 1))
    tail = F.trim(F.substring(c, bar + 1, F.length(c)))
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"\+\s*\d+\|", ""), r"\d+\s+\d+(;\d+\s+\d+)*", ""), r"^or\s+", "")
    tail = F.when(F.trim(tail) != "", F.trim(tail)).otherwise("Unknown concept")
    return F.when(bar == 0, F.trim(c)).otherwise(F.when((head == "") | (head == "+"), tail).otherwise(head))


def tabular(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A tab-separated table of terms in example sentences: one document a row; ids stay strings."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    blank = lambda c: F.when(F.col(c).isNull() | (F.col(c) == "nan"), "").otherwise(F.regexp_replace(F.col(c), r"\.0$", ""))
    at = F.call_function("locate", F.lower("Term"), F.lower("Example"))
    start = F.when(at > 0, at - 1).otherwise(0)
    return rows.select(F.concat(F.lit(f"row_{split}_"), blank("ID")).alias("doc_id"), F.lit(split).alias("split"), F.col("Example").alias("doc_text"), start.alias("start"), (start + F.length("Term")).alias("end"), F.col("Term").alias("text"), blank("General SNOMED ID").alias("general_id"), blank("Specific SNOMED ID").alias("specific_id"))


_LABEL = """_drug string, Text struct<Section:array<struct<_VALUE:string,_id:string,_name:string>>>,
 Mentions struct<Mention:array<struct<_id:string,_section:string,_type:string,_start:string,_len:string,_str:string>>>,
 Reactions struct<Reaction:array<struct<_id:string,_str:string,Normalization:array<struct<_meddra_pt:string,_meddra_pt_id:string>>>>>"""


def labels(spark: SparkSession, path: str, split: str | None = None, keep_parts: bool = False, drop_documents: bool = False) -> DataFrame:
    """XML drug labels. A document is its sections joined by two line ends; offsets move with their section.

    Mentions of several parts (comma lists) go, or with keep_parts stay with a row a
    part, or with drop_documents the whole document goes. The preferred term comes from the reaction of the same text, else of the
    same lower-case text; of several reactions the last counts.
    """
    rows = spark.read.format("xml").options(rowTag="Label", ignoreSurroundingSpaces="false").schema(_LABEL).load(path)
    if drop_documents:
        listed = F.exists("Mentions.Mention", lambda m: m["_start"].contains(",") | m["_len"].contains(","))
        rows = rows.where(~F.coalesce(listed, F.lit(False)))
    sections = F.col("Text.Section")
    rows = rows.select(F.col("_drug").alias("doc_id"), sections.alias("s"), F.array_join(F.transform(sections, lambda x: F.coalesce(x["_VALUE"], F.lit(""))), "\n\n").alias("doc_text"), F.col("Mentions.Mention").alias("m"), F.col("Reactions.Reaction").alias("r"))
    before = lambda m: F.aggregate(F.slice("s", 1, F.greatest(F.array_position(F.transform("s", lambda x: x["_id"]), m["_section"]) - 1, F.lit(0)).cast("int")), F.lit(0), lambda n, x: n + F.length(F.coalesce(x["_VALUE"], F.lit(""))) + 2)
    out = rows.select("doc_id", "doc_text", "r", F.explode("m").alias("m"), "s").select("doc_id", "doc_text", "r", "m", before(F.col("m")).alias("offset"))
    out = out.select("doc_id", "doc_text", "r", "m", "offset", F.explode(F.arrays_zip(F.split("m._start", ",").alias("a"), F.split("m._len", ",").alias("n"))).alias("p"))
    if not keep_parts:
        out = out.where(~F.col("m._start").contains(","))
    start = F.col("offset") + F.trim("p.a").try_cast("int")
    same = lambda f: F.filter("r", lambda x: f(x["_str"]) == f(F.col("m._str")))
    reaction = F.coalesce(F.try_element_at(same(lambda c: c), F.lit(-1)), F.try_element_at(same(F.lower), F.lit(-1)))
    norm = F.try_element_at(reaction["Normalization"], F.lit(1))
    return out.select("doc_id", F.lit(split).cast("string").alias("split"), "doc_text", start.alias("start"), (start + F.trim("p.n").try_cast("int")).alias("end"), F.col("m._str").alias("text"), F.coalesce("m._type", F.lit("AdverseReaction")).alias("entity_type"), F.col("m._id").alias("mention_id"), norm["_meddra_pt_id"].alias("code"), norm["_meddra_pt"].alias("term")).where("start is not null")


def notes(spark: SparkSession, notes_path: str, annotations_path: str) -> DataFrame:
    """Notes and their annotations as two CSV tables; annotations of no note go, and the mention is what the span covers."""
    read = lambda p: spark.read.csv(p, header=True, multiLine=True, quote='"', escape='"')
    texts = read(notes_path).select("note_id", F.col("text").alias("doc_text"))
    marks = read(annotations_path).select("note_id", F.col("start").try_cast("int").alias("start"), F.col("end").try_cast("int").alias("end"), F.col("concept_id").alias("code"))
    mention = F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return marks.join(texts, "note_id").select(F.col("note_id").alias("doc_id"), F.lit(None).cast("string").alias("split"), "doc_text", "start", "end", mention.alias("text"), "code")


def pipe_standoff(spark: SparkSession, texts: str, annotations: str, split: str | None = None) -> DataFrame:
    """Reports with `file.txt|spans|CUI|...` records, perhaps on one line; comma spans are a row each; CUI-less ones go."""
    docs = whole_files(spark, texts).select(F.col("stem").alias("doc_id"), F.col("text").alias("doc_text"))
    marks = whole_files(spark, annotations).withColumn("stem", F.regexp_replace("stem", r"\.pipe$", ""))
    marks = marks.select(F.col("stem").alias("doc_id"), F.expr(r"explode(split(text, concat('\\Q', stem, '.txt|', '\\E')))").alias("record"))
    fields = F.split("record", r"\|")
    marks = marks.where(F.size(fields) >= 2).select("doc_id", fields[0].alias("spans"), F.trim(fields[1]).alias("code")).where(~F.upper("code").isin("CUI-LESS", "NULL", ""))
    marks = marks.select("doc_id", "code", F.explode(F.split("spans", ",")).alias("s"))
    at = lambda k: F.try_element_at(F.split(F.trim("s"), "-"), F.lit(k)).try_cast("int")
    out = marks.select("doc_id", "code", at(1).alias("start"), at(2).alias("end")).join(docs, "doc_id").where("start >= 0 and start < end and end <= length(doc_text)")
    return out.select("doc_id", F.lit(split).cast("string").alias("split"), "doc_text", "start", "end", F.substring(F.col("doc_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "code")
