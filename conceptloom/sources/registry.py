"""The nine corpora: where their files lie, and their mentions in one form.

A projection returns a row a mention: doc_id, split, doc_text, start, end, text, native_id,
native_ontology_name, what the corpus's tries read, and fields of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import mentions
from . import corpora
from .processed import exists


def _union(found: list[DataFrame], what: str, folder: str) -> DataFrame:
    if not found:
        raise FileNotFoundError(f"no files of {what} in {folder}")
    return reduce(DataFrame.unionByName, found)


def _by_split(spark: SparkSession, folder: str, files: dict[str, str], read: Callable[[str, str], DataFrame], what: str) -> DataFrame:
    """The files of the splits that are there."""
    return _union([read(f"{folder}/{name}", split) for split, name in files.items() if exists(spark, f"{folder}/{name}")], what, folder)


def _named(rows: DataFrame, ontology: str, **more: object) -> DataFrame:
    return rows.withColumns({"native_ontology_name": F.lit(ontology)} | {k: F.lit(v) if isinstance(v, str) else v for k, v in more.items()})


def _span_id() -> Column:
    return F.concat_ws("_", "doc_id", "start", "end")


def cdr(spark: SparkSession, folder: str) -> DataFrame:
    """A mention an id of a `|` list."""
    files = {"train": "CDR_TrainingSet.PubTator.txt", "dev": "CDR_DevelopmentSet.PubTator.txt", "test": "CDR_TestSet.PubTator.txt"}
    rows = _by_split(spark, folder, files, lambda path, split: corpora.pubtator(spark, path, split), "cdr")
    return _named(mentions.explode_ids(rows), "MSH").drop("concept", "part")


def ncbi(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of ids of one source are a mention each; others are one mention with candidates in order."""
    files = {"train": "NCBItrainset_corpus.txt", "dev": "NCBIdevelopset_corpus.txt", "test": "NCBItestset_corpus.txt"}
    rows = _by_split(spark, folder, files, lambda path, split: corpora.pubtator(spark, path, split), "ncbi")
    rows = mentions.split_policy(rows)
    omim = F.col("concept").contains("OMIM:")
    alone = F.struct(F.when(omim, "OMIM").otherwise("MSH").alias("sab"), F.replace("concept", F.lit("OMIM:"), F.lit("")).alias("code"))
    rows = rows.withColumn("candidates", F.when(F.size("candidates") > 0, F.col("candidates")).when(F.col("concept") != "", F.array(alone)).otherwise(F.array().cast("array<struct<sab:string,code:string>>")))
    first = F.try_element_at("candidates", F.lit(1))
    return rows.withColumns({"concept_id": F.col("concept"), "native_id": first["code"], "native_ontology_name": first["sab"]}).drop("concept", "part", "sab", "code")


def medmentions(spark: SparkSession, folder: str) -> DataFrame:
    """One corpus with lists of ids; the type is the first of the type list."""
    lists = {"train": "corpus_pubtator_pmids_trng.txt", "dev": "corpus_pubtator_pmids_dev.txt", "test": "corpus_pubtator_pmids_test.txt"}
    found = {split: f"{folder}/{name}" for split, name in lists.items() if exists(spark, f"{folder}/{name}")}
    rows = corpora.pubtator_splits(spark, f"{folder}/corpus_pubtator.txt", found)
    return _named(rows, "UMLS", native_id=F.trim("concept"), cui=F.trim("concept"), semantic_types_full=F.col("entity_type")).drop("concept", "entity_type")


def cadec(spark: SparkSession, folder: str) -> DataFrame:
    """Clinical and drug-dictionary ids of one span; the first comes from the clinical folder."""
    folder = folder if exists(spark, f"{folder}/text") else f"{folder}/cadec"
    rows = corpora.dual_standoff(spark, *(f"{folder}/{part}" for part in ("text", "sct", "meddra")))
    told = lambda c: F.when(codes.conceptless(F.col(c)), "").otherwise(F.coalesce(F.col(c), F.lit("")))
    rows = rows.withColumns({"snomed_id": told("first_id"), "meddra_id": told("second_id")})
    rows = rows.withColumn("meddra_id", F.when(F.col("meddra_id").rlike("^[0-9]{5,}$"), F.col("meddra_id")).otherwise(""))
    pick = lambda first, second, none: F.when(F.col("snomed_id") != "", first).when(F.col("meddra_id") != "", second).otherwise(none)
    return rows.withColumns({"native_id": pick(F.col("snomed_id"), F.col("meddra_id"), F.lit("")), "native_ontology_name": pick(F.lit("SNOMEDCT_US"), F.lit("MDR"), F.lit(""))}).drop("first_id", "second_id")


def cometa(spark: SparkSession, folder: str) -> DataFrame:
    """Terms in sentences, with a specific and a general id."""
    files = {split: f"splits/random/{split}.csv" for split in ("train", "dev", "test")}
    rows = _by_split(spark, folder, files, lambda path, split: corpora.tabular(spark, path, split), "cometa")
    best = F.when(F.col("specific_id") != "", F.col("specific_id")).otherwise(F.col("general_id"))
    more = {"doc_id": F.regexp_replace("doc_id", "^row_", "cometa_"), "native_id": best, "specific_snomed_id": F.col("specific_id"), "general_snomed_id": F.col("general_id")}
    return _named(rows, "SNOMEDCT_US", entity_type="Medical Term", **more)


def adr(spark: SparkSession, folder: str) -> DataFrame:
    """Drug labels; files in no split's folder have the split unknown. A label with a mention of several parts is left out whole."""
    splits = [s for s in ("train", "test") if exists(spark, f"{folder}/{s}")]
    read = lambda path, split: corpora.labels(spark, f"{path}/*.xml", split, drop_documents=True)
    rows = _union([read(f"{folder}/{s}", s) for s in splits], "adr", folder) if splits else read(folder, "unknown")
    return _named(rows, "MDR", native_id=F.coalesce("code", F.lit("")), meddra_pt=F.coalesce("term", F.lit(""))).drop("code", "term")


def mantra(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-off pairs in folders of the English part, which are named in the document's id."""
    at = f"{folder}/English"
    return _named(corpora.standoff_pairs(spark, at, at, with_folder=True), "UMLS", native_id=F.col("code"), entity_type="Biomedical Entity").drop("code")


def mimic(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and annotations as tables."""
    rows = corpora.notes(spark, f"{folder}/mimic-iv_notes_training_set_cleaned.csv", f"{folder}/train_annotations_cleaned.csv")
    return _named(rows, "SNOMEDCT_US", native_id=F.col("code"), entity_type="Clinical Entity", annotation_id=_span_id()).drop("code")


def share(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with records in bars, a folder of texts and one of annotations a split."""
    found = [s for s, top in (("train", "training_corpus"), ("test", "test_corpus")) if exists(spark, f"{folder}/{top}/{s}") and exists(spark, f"{folder}/{top}/{s}_ann")]
    top = {"train": "training_corpus", "test": "test_corpus"}
    rows = _union([corpora.pipe_standoff(spark, f"{folder}/{top[s]}/{s}", f"{folder}/{top[s]}/{s}_ann", s) for s in found], "share", folder)
    return _named(rows, "UMLS", native_id=F.col("code"), entity_type="Clinical Entity", annotation_id=_span_id()).drop("code")


@dataclass(frozen=True)
class Definition:
    """A corpus: its folder under the data, the ontologies of its ids, how its mentions are read, and the fields that it writes beside the standard ones."""

    folder: str
    ontologies: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    extra: tuple[str, ...] = ()
    licensed: bool = False
    keeps_split: bool = False


#: Names, folders, ontologies and fields of the corpora.
CORPORA = {
    "cdr": Definition("CDR_Data/CDR.Corpus.v010516", ("MSH",), cdr, ("entity_type",), keeps_split=True),
    "ncbi": Definition("NCBI", ("MSH", "OMIM"), ncbi, ("entity_type",)),
    "medmentions": Definition("medmentions", ("UMLS",), medmentions, ("semantic_types_full",)),
    "cadec": Definition("CADEC", ("SNOMEDCT_US", "MDR"), cadec, ("snomed_id", "snomed_name", "meddra_id", "annotation_id")),
    "cometa": Definition("cometa", ("SNOMEDCT_US",), cometa, ("specific_snomed_id", "general_snomed_id")),
    "adr": Definition("ADR_cleaned", ("MDR",), adr, ("entity_type", "mention_id", "meddra_pt")),
    "mantra": Definition("Mantra-GSC", ("UMLS",), mantra, ("entity_type",)),
    "mimic": Definition("MIMICIV_EL_cleaned_no_placeholders", ("SNOMEDCT_US",), mimic, ("entity_type", "annotation_id"), licensed=True),
    "share": Definition("shareclef_cleaned", ("UMLS",), share, ("entity_type", "annotation_id"), licensed=True),
}
