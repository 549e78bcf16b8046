"""Writers of documents, cross-walks, statistics and paths."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .processed import exists


def documents_json(documents: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "split")) -> None:
    """JSON lines, a folder a dataset and split."""
    documents.write.mode("overwrite").partitionBy(*[c for c in by if c in documents.columns]).json(path)


def documents_by_split(documents: DataFrame, folder: str, name: str, keep_split: bool = False) -> None:
    """`<name>_<split>.jsonl`, a folder of JSON lines a split; without a split, or unknown, `<name>.jsonl`.

    All splits are written in one pass to a place of their own, and take their names when all of them are there; what
    stood under these names goes then. keep_split: documents tell their split, and unknown is one by name.
    """
    spark = documents.sparkSession
    made = f"{folder.rstrip('/')}/_{name}-{uuid.uuid4().hex}"
    rows = documents.withColumn("_split", F.coalesce(F.when(F.col("split") != "", F.col("split")), F.lit("unknown")))
    (rows if keep_split else rows.drop("split")).write.partitionBy("_split").json(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in fs.globStatus(path(f"{folder.rstrip('/')}/{name}*.jsonl")) or []:
        if re.fullmatch(rf"{re.escape(name)}(_[^_/]*)?\.jsonl", old.getPath().getName()):
            fs.delete(old.getPath(), True)
    for part in fs.listStatus(path(made)):
        if part.isDirectory():
            split = unquote(part.getPath().getName().partition("=")[2])
            split = quote(split, safe="")
            own = f"{name}.jsonl" if split == "unknown" and not keep_split else f"{name}_{split}.jsonl"
            if not fs.rename(part.getPath(), path(f"{folder.rstrip('/')}/{own}")):
                raise OSError(f"{own} could not be written")
    fs.delete(path(made), True)


def crosswalk_json(codes: DataFrame, path: str) -> None:
    """A JSON line a concept: {cui, sources: {source: {code: {tty, term}}}}."""
    entry = F.struct("tty", "term")
    per_source = codes.groupBy("cui", "sab").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", entry.alias("e"))))).alias("codes"))
    out = per_source.groupBy("cui").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sab", F.to_json("codes").alias("c"))))).alias("sources"))
    out.write.mode("overwrite").json(path)


def crosswalk_files(codes: DataFrame, types: DataFrame, linked: DataFrame, dataset: str, folder: str) -> None:
    """A corpus's four files: codes with term types, semantic types, statistics of term types, and a summary."""
    from ..operators import statistics

    at = lambda name: f"{folder.rstrip('/')}/{dataset}_{name}"
    used = linked.where(statistics.HAS_CUI).select("cui").distinct()
    crosswalk_json(codes, at("cui_to_vocab_codes_with_tty"))
    own = types.join(used, "cui", "left_semi")
    statistics.concept_types(own).write.mode("overwrite").json(at("cui_to_tuis"))
    statistics_json(statistics.term_type_counts(codes), at("tty_statistics"))
    statistics_json(statistics.mapping_summary(used, codes, own, dataset), at("enhanced_mapping_summary"))


def combined_files(crosswalks: DataFrame, types: DataFrame, folder: str) -> None:
    """Of all corpora together: codes by concept (corpora of later names win), semantic types in order of appearance, and a summary. Sorted by concept."""
    from ..operators import statistics

    at = lambda name: f"{folder.rstrip('/')}/{name}"
    codes = crosswalks.groupBy("cui", "sab", "code").agg(F.max_by("tty", "dataset").alias("tty"), F.max_by("term", "dataset").alias("term"))
    crosswalk_json(codes, at("combined_cui_to_vocab_codes_with_tty"))
    listed = codes.groupBy("cui", "sab").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    listed = listed.groupBy("cui").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sab", "codes")))).alias("sources"))
    listed.orderBy("cui").write.mode("overwrite").json(at("combined_cui_to_vocab_codes"))
    statistics.concept_types(types).orderBy("cui").write.mode("overwrite").json(at("combined_cui_to_tuis"))
    statistics_json(statistics.mapping_summary(crosswalks.select("cui").distinct(), codes, types, "all"), at("cross_dataset_mapping_summary"))


def cleaned_texts(rows: DataFrame, path: str, kind: str = "text") -> None:
    """Cleaned documents: as lines of text (value), CSV with a header, or XML elements `Document`."""
    out = rows.write.mode("overwrite")
    if kind == "text":
        out.text(path)
    elif kind == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    else:
        out.format("xml").option("rowTag", "Document").option("rootTag", "Documents").save(path)


def paths_of(spark, folder: str, vocabulary: str) -> DataFrame | None:
    """cui, code, path of a vocabulary that runs before have written; None if none has."""
    at = f"{folder.rstrip('/')}/paths"
    if not exists(spark, f"{at}/vocab={vocabulary}"):
        return None
    return spark.read.parquet(at).where(F.col("vocab") == vocabulary)


def statistics_json(statistics: DataFrame, path: str) -> None:
    """Aggregates are small: one file."""
    statistics.coalesce(1).write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    """A small report's rows, added to what is there."""
    rows.coalesce(1).write.mode("append").json(path)


def paths_table(paths: DataFrame, path: str, mode: str = "append") -> None:
    """Paths by vocabulary; runs that go on where one stopped append."""
    paths.write.mode(mode).partitionBy("vocab").parquet(path)


def folder_of(vocabulary: str) -> str:
    """A vocabulary's folder name."""
    name = vocabulary.lower().replace("_", "").replace("v2", "")
    return {"mdr": "meddra", "snomedctus": "snomed", "lnc": "loinc", "msh": "mesh"}.get(name, name)
