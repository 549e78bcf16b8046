"""Processed corpora and configuration: readers of what the corpus stage writes, and of the small files that steer it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MENTION = "start long, end long, text string, native_id string, native_ontology_name string, cui string, umls_name string, semantic_type string, mapping_method string, specific_snomed_id string, general_snomed_id string"
DOCUMENT = "doc_id string, text string, split string, mentions array<struct<" + ", ".join(f"`{x.split()[0]}`:{x.split()[1]}" for x in MENTION.split(", ")) + ">>"
SPLITS = ("", "_train", "_test", "_dev")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def processed(spark: SparkSession, folder: str, dataset: str) -> DataFrame | None:
    """Documents of `<dataset>.jsonl` and its splits' files, those that are there, with `dataset` and `file`; None if none is.

    A file may be a folder of parts. A document that doesn't tell its split has its file's.
    """
    found = [path for suffix in SPLITS if exists(spark, path := f"{folder.rstrip('/')}/{dataset}{suffix}.jsonl")]
    if not found:
        return None
    rows = spark.read.schema(DOCUMENT).json(found).where("doc_id is not null or text is not null")
    rows = rows.withColumn("dataset", F.lit(dataset)).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+\.jsonl)", 1))
    told = F.regexp_extract("file", r"_(train|test|dev)\.jsonl$", 1)
    return rows.withColumn("split", F.coalesce("split", F.when(told != "", told).otherwise("unknown")))


def mentions_of(documents: DataFrame) -> DataFrame:
    """A row a mention, with the document's dataset, doc_id and split."""
    return documents.select("dataset", "doc_id", "split", F.explode("mentions").alias("m")).select("dataset", "doc_id", "split", "m.*")


def semantic_groups(spark: SparkSession, path: str) -> DataFrame:
    """tui, group, group_name, type_name of a semantic group map: {semantic_groups: {group: {name, types: {tui: {name}}}}}."""
    schema = "semantic_groups map<string,struct<name:string,types:map<string,struct<name:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("semantic_groups").alias("group", "g"))
    rows = rows.select("group", F.col("g.name").alias("group_name"), F.explode("g.types").alias("tui", "t"))
    return rows.select("tui", "group", "group_name", F.col("t.name").alias("type_name"))


def vocabulary_list(path: str) -> list[str]:
    """Names of a vocabulary list, in order of id."""
    with open(path) as f:
        return [x["name"] for x in sorted(json.load(f)["vocabularies"], key=lambda x: x["id"])]


def restricted(path: str) -> list[str]:
    """Datasets that need a licence: a JSON list."""
    with open(path) as f:
        return json.load(f)


@dataclass
class Versions:
    """Versions of vocabularies: what a run says comes first, then the entry of the vocabulary, then the default."""

    own: dict[str, str] = field(default_factory=dict)
    default: str | None = None
    override: str | None = None

    def of(self, vocabulary: str) -> str | None:
        return self.override or self.own.get(vocabulary) or self.default


def must_have(spark: SparkSession, folder: str, dataset: str, licensed: list[str]) -> bool:
    """Whether a dataset's folder is there. One that needs a licence may be absent and is skipped; any other raises."""
    if exists(spark, folder):
        return True
    if dataset in licensed:
        return False
    raise FileNotFoundError(f"no data of {dataset} in {folder}")
