"""Readers of vocabularies that come as service records: nodes, edges, levels and lineages from JSON or XML files, one record a line or element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of a MedDRA record, top first, and the fields of their code and name.
MEDDRA_LEVELS = ("soc", "hlgt", "hlt", "pt", "llt")


def snomed(spark: SparkSession, concepts: str, parents: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (code, name, active) from concept records, edges (child, parent, name) from parents' records.

    A parents' record has the child's id in `conceptId` and the parents in `parents`, a list or {items: list}. A
    concept without a preferred term is called N/A.
    """
    rows = spark.read.schema("conceptId string, active boolean, pt struct<term:string>").json(concepts)
    nodes = rows.select(F.col("conceptId").alias("code"), F.coalesce("pt.term", F.lit("N/A")).alias("name"), F.coalesce("active", F.lit(False)).alias("active")).where("code is not null")
    one = "array<struct<conceptId:string,pt:struct<term:string>>>"
    links = spark.read.schema("conceptId string, parents string").json(parents)
    found = F.coalesce(F.from_json("parents", one), F.from_json("parents", f"items {one}")["items"])
    found = F.when(F.trim("parents").startswith("{"), F.from_json("parents", f"items {one}")["items"]).otherwise(found)
    links = links.select(F.col("conceptId").alias("child"), F.posexplode(found).alias("pos", "p")).where("p.conceptId is not null")
    return nodes, links.select("child", F.col("p.conceptId").alias("parent"), F.coalesce("p.pt.term", F.lit("N/A")).alias("name"), "pos")


def loinc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (code, name) and edges (child, parent, pos) from lookup responses with their `code`: the display, and properties whose code is parent."""
    part = "array<struct<name:string,valueCode:string,valueCoding:struct<code:string>>>"
    rows = spark.read.schema(f"code string, parameter array<struct<name:string,valueString:string,part:{part}>>").json(path).where("code is not null")
    named = F.filter("parameter", lambda x: x["name"] == "display")
    parent = F.filter("parameter", lambda x: (x["name"] == "property") & F.exists(x["part"], lambda y: (y["name"] == "code") & (y["valueCode"] == "parent")))
    codes = F.transform(parent, lambda x: F.try_element_at(F.filter(x["part"], lambda y: y["name"] == "value"), F.lit(-1))["valueCoding"]["code"])
    edges = rows.select(F.col("code").alias("child"), F.posexplode(codes).alias("pos", "parent")).where("parent is not null")
    return rows.select("code", F.try_element_at(named, F.lit(-1))["valueString"].alias("name")), edges.select("child", "parent", "pos")


def meddra(spark: SparkSession, path: str) -> DataFrame:
    """Wide rows of detail records: code, type, and code and name of each level. `llt` only where it is not the preferred term again."""
    fields = ", ".join(f"{x}_code string, {x}_name string" for x in MEDDRA_LEVELS)
    rows = spark.read.schema(f"code string, type string, {fields}").json(path).where("code is not null")
    again = F.col("llt_code") == F.col("pt_code")
    return rows.withColumns({f"llt_{x}": F.when(~F.coalesce(again, F.lit(False)), F.col(f"llt_{x}")) for x in ("code", "name")})


def meddra_paths(rows: DataFrame) -> DataFrame:
    """code, path of the wide rows' levels, nodes (code, name); levels without a code are left out."""
    steps = F.array(*[F.when(F.coalesce(F.col(f"{x}_code"), F.lit("")) != "", F.struct(F.col(f"{x}_code").alias("code"), F.coalesce(f"{x}_name", F.lit("")).alias("name"))) for x in MEDDRA_LEVELS])
    return rows.select("code", F.array_compact(steps).alias("path")).where(F.size("path") > 0)


def ncbi_lineages(spark: SparkSession, path: str) -> DataFrame:
    """code, path from taxon records in XML: the lineage from the root on, then the taxon itself."""
    one = "TaxId:string,ScientificName:string"
    schema = f"Taxon array<struct<{one},LineageEx:struct<Taxon:array<struct<{one}>>>>>"
    rows = spark.read.format("xml").option("rowTag", "TaxaSet").schema(schema).load(path).select(F.explode("Taxon").alias("t"))
    node = lambda x: F.struct(x["TaxId"].alias("code"), x["ScientificName"].alias("name"))
    above = F.coalesce(F.transform("t.LineageEx.Taxon", node), F.array().cast("array<struct<code:string,name:string>>"))
    return rows.where("t.TaxId is not null").select(F.col("t.TaxId").alias("code"), F.concat(above, F.array(node(F.col("t")))).alias("path"))
