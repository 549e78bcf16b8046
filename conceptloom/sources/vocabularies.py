"""Readers of concept releases and vocabularies, as atoms, types, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_if_small
from .corpora import blocks

#: Places of the fields in release rows, which end with a bar.
ATOM_FIELDS = {"cui": 0, "lat": 1, "ispref": 6, "sab": 11, "tty": 12, "code": 13, "str": 14}
TYPE_FIELDS = {"cui": 0, "tui": 1, "name": 3}


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and line_no: lines numbered from 0 without gaps, files in order of their paths, however many files and splits there are.

    The first pass counts the lines of each split of a file, and a sum over the splits before gives its
    first number; within a split, rows come in order. Lines without text have a number, and go.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("whole").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    # a row a split, few beside the lines
    starts = splits.withColumn("whole", F.lit(0)).select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(broadcast_if_small(starts, "splits"), ["file", "block"]).select("value", (F.col("id") + F.col("shift")).alias("line_no")).where("trim(value) <> ''")


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """cui, lat, ispref, sab, tty, code, str, line_no; rows of fewer than 15 fields go."""
    rows = numbered_lines(spark, path).select("line_no", F.split("value", r"\|").alias("f")).where(F.size("f") >= 15)
    return rows.select(*[F.col("f")[k].alias(c) for c, k in ATOM_FIELDS.items()], "line_no")


def semantic_types(spark: SparkSession, path: str) -> DataFrame:
    """cui, tui, name, pos."""
    rows = numbered_lines(spark, path).select("line_no", F.split("value", r"\|").alias("f")).where(F.size("f") >= 4)
    return rows.select(*[F.col("f")[k].alias(c) for c, k in TYPE_FIELDS.items()], F.col("line_no").alias("pos"))


def descriptor_trees(spark: SparkSession, path: str) -> DataFrame:
    """tree, code, name from descriptor records in XML; a tree number's last descriptor counts."""
    schema = "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>"
    rows = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.select(F.explode("TreeNumberList.TreeNumber").alias("tree"), F.col("DescriptorUI").alias("code"), F.col("DescriptorName.String").alias("name"), "at")
    return rows.groupBy("tree").agg(F.max_by("code", "at").alias("code"), F.max_by("name", "at").alias("name"))


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (code, name) and edges (child, parent) of term stanzas; obsolete terms go."""
    rows = blocks(spark, path).select(F.array_join("lines", "\n").alias("value")).where(F.trim("value").startswith("[Term]"))
    get = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}: *(.*)$", 1)
    rows = rows.where(~F.col("value").rlike(r"(?m)^is_obsolete: *true")).select(F.trim(get("id")).alias("code"), F.trim(get("name")).alias("name"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: *(\S+)"), 1).alias("parents"))
    return rows.select("code", "name"), rows.select(F.col("code").alias("child"), F.explode("parents").alias("parent"))


def owl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of named classes `C<digits>`; parents are direct classes or values of restrictions."""
    schema = "`_rdf:about` string, `rdfs:label` array<string>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string, `owl:Restriction`:struct<`owl:someValuesFrom`:struct<`_rdf:resource`:string>>>>"
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    tail = lambda c: F.regexp_extract(c, r"(C[0-9]+)$", 1)
    rows = rows.select(tail(F.col("`_rdf:about`")).alias("code"), F.try_element_at("rdfs:label", F.lit(1)).alias("name"), F.explode_outer("`rdfs:subClassOf`").alias("s")).where("code <> ''")
    parent = tail(F.coalesce(F.col("s.`_rdf:resource`"), F.col("s.`owl:Restriction`.`owl:someValuesFrom`.`_rdf:resource`"), F.lit("")))
    return rows.select("code", "name").distinct(), rows.select(F.col("code").alias("child"), parent.alias("parent")).where("parent <> ''").distinct()


def json_ld(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of concept records, a JSON value a line (an object, a list, or one with @graph)."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    item = "coalesce(try_variant_get(v, '$[\"@graph\"]', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'), array(v))"
    rows = rows.select(F.explode(F.expr(item)).alias("c"))
    get = lambda p, t="string": F.expr(f"try_variant_get(c, '{p}', '{t}')")
    rows = rows.where(get('$["@type"]') == "skos:Concept")
    label = F.coalesce(get('$["skos:prefLabel"]["@value"]'), get('$["skos:prefLabel"][0]["@value"]'), get('$["skos:prefLabel"][0]'), get('$["skos:prefLabel"]'))
    broader = F.coalesce(F.transform(get('$["skos:broader"]', "array<variant>"), lambda x: F.try_variant_get(x, '$["@id"]', "string")), F.array(F.coalesce(get('$["skos:broader"]["@id"]'), get('$["skos:broader"]'))))
    tail = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    rows = rows.select(tail(get('$["@id"]')).alias("code"), label.alias("name"), broader.alias("b"))
    return rows.select("code", "name"), rows.select(F.col("code").alias("child"), F.explode("b").alias("p")).where("p is not null").select("child", tail(F.col("p")).alias("parent"))


def code_lines(spark: SparkSession, path: str) -> DataFrame:
    """code, name from lines `code name`."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+", 2).alias("f")).where(F.size("f") == 2)
    return rows.select(F.col("f")[0].alias("code"), F.col("f")[1].alias("name"))


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """cui, sab, code, tty from JSON {cui: {source: ...}}: codes with types, codes with entries, or a list of codes."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("cui", "sources"))
    rows = rows.select("cui", F.explode("sources").alias("sab", "v"))
    listed = F.from_json("v", "array<string>")
    coded = F.from_json("v", "codes array<string>, code_meta map<string,struct<tty:string>>, meta map<string,struct<tty:string>>")
    entries = F.from_json("v", "map<string,struct<tty:string>>")
    types = F.coalesce(coded["code_meta"], coded["meta"])
    one = lambda code, tty: F.struct(code.alias("code"), tty.alias("tty"))
    items = (
        F.when(F.trim("v").startswith("["), F.transform(listed, lambda c: one(c, F.lit(None).cast("string"))))
        .when(coded["codes"].isNotNull(), F.transform(coded["codes"], lambda c: one(c, F.try_element_at(types, c)["tty"])))
        .otherwise(F.transform(F.map_entries(entries), lambda e: one(e["key"], e["value"]["tty"])))
    )
    return rows.select("cui", "sab", F.explode(items).alias("x")).select("cui", "sab", "x.code", "x.tty")
