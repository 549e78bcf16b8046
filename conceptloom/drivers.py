"""The three runs: corpora to linked documents, concepts to paths, and statistics over what was written.

Each run is a handful of Spark jobs a dataset or vocabulary; nothing is gathered but small aggregates. A failure
raises: a run that ends has written all it names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import codes as code_forms
from .operators import concepts, datasets, hierarchy, mentions, statistics, traversal
from .session import cut_lineage, scratch
from .sources import processed, registry, sinks

#: The fields of a written mention; what a mention lacks is ''.
STANDARD = ("start", "end", "text", "native_id", "native_ontology_name", "cui", "umls_name", "semantic_type", "mapping_method")


@dataclass(frozen=True)
class Corpus:
    """A dataset's name, its spec of tries, how its mentions are read (doc_id, split, doc_text, start, end, text and the spec's columns), and fields written beside the standard ones."""

    name: str
    spec: str
    read: Callable[[SparkSession], DataFrame]
    extra: tuple[str, ...] = ()
    keeps_split: bool = False


def known_corpora(spark: SparkSession, data: str, names: Iterable[str] | None = None) -> list[Corpus]:
    """The corpora that this package knows, read from their folders under `data`. One that needs a licence and isn't there is left out; any other has to be there."""
    names = list(registry.CORPORA if names is None else names)
    licensed = [n for n, d in registry.CORPORA.items() if d.licensed]
    out = []
    for name in names:
        known = registry.CORPORA[name]
        folder = f"{data.rstrip('/')}/{known.folder}"
        if processed.must_have(spark, folder, name, licensed):
            out.append(Corpus(name, name, lambda s, known=known, folder=folder: known.read(s, folder), known.extra, known.keeps_split))
    return out


def standard_mentions(rows: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """doc_id, split, doc_text, the standard fields and extra ones; texts that are missing are ''."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if kinds.get(c) == "string" else F.col(c) if c in kinds else F.lit("")
    return rows.select("doc_id", "split", "doc_text", *[text(c).alias(c) for c in (*STANDARD, *extra)])


def first_documents(rows: DataFrame, most: int | None, doc_id: str = "doc_id") -> DataFrame:
    """The mentions of the first documents, by id; all without a limit."""
    if most is None:
        return rows
    return rows.join(F.broadcast(rows.select(doc_id).distinct().orderBy(doc_id).limit(most)), doc_id, "left_semi")


def link_corpus(corpus: Corpus, spark: SparkSession, atoms: DataFrame | concepts.Indexes, types: DataFrame, most_documents: int | None = None) -> DataFrame:
    """A corpus's mentions, linked, in standard form; umls_name is the concept's preferred name, semantic_type its first type unless the corpus tells one."""
    index = concepts.Indexes.of(atoms)
    rows = first_documents(corpus.read(spark), most_documents)
    if "semantic_type" not in rows.columns:
        rows = rows.withColumn("semantic_type", F.lit(""))
    linked = datasets.link(rows, index, types, datasets.SPECS[corpus.spec]).drop("cui").withColumnsRenamed({"linked": "cui", "method": "mapping_method"})
    linked = linked.join(concepts.preferred_names(index.atoms).withColumnRenamed("name", "umls_name"), "cui", "left")
    linked = linked.join(concepts.first_types(types).withColumnRenamed("tui", "first_type"), "cui", "left")
    linked = linked.withColumn("semantic_type", F.when(F.coalesce("semantic_type", F.lit("")) != "", F.col("semantic_type")).otherwise(F.coalesce("first_type", F.lit(""))))
    return standard_mentions(linked.drop("first_type"), corpus.extra)


def crosswalk_of(linked: DataFrame, atoms: DataFrame) -> DataFrame:
    """cui, sab, code, tty, term of every code of the concepts that a corpus has, by English atoms of allowed sources."""
    return concepts.crosswalk(atoms, linked.where(statistics.HAS_CUI).select("cui"))


def process_corpora(spark: SparkSession, corpora: list[Corpus], atoms: DataFrame, types: DataFrame, out: str, suffix: str = "", most_documents: int | None = None) -> dict[str, int]:
    """Links each corpus and writes documents, cross-walk files and statistics under out/name+suffix. Returns mentions by corpus.

    Codes and names come from atoms of allowed sources alone; their indexes serve all corpora. A corpus's intermediate tables go when it is written.
    """
    done, atoms = {}, cut_lineage(concepts.usable(atoms), "atoms")
    index = concepts.Indexes(atoms).ready()
    for corpus in corpora:
        with scratch(spark):
            folder = f"{out.rstrip('/')}/{corpus.name}{suffix}"
            linked = cut_lineage(link_corpus(corpus, spark, index, types, most_documents), f"linked-{corpus.name}")
            documents = mentions.to_documents(linked, ["doc_id", "split", "doc_text"], [*STANDARD, *corpus.extra], ["start", "end"]).withColumnRenamed("doc_text", "text")
            sinks.documents_by_split(documents, f"{folder}/documents", corpus.name, corpus.keeps_split)
            sinks.crosswalk_files(crosswalk_of(linked, atoms), types, linked, corpus.name, f"{folder}/mappings")
            sinks.statistics_json(statistics.rates(statistics.basic(linked)), f"{folder}/statistics")
            done[corpus.name] = linked.count()
    return done


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary's name, which codes it takes, and how paths (code, path) come from codes (code).

    skipped: codes that are left out beforehand; active: which codes are in use; invalid, nothing: what codes of a wrong form, and those
    without a path, are called in the status.
    """

    name: str
    valid: Callable
    paths: Callable[[DataFrame], DataFrame]
    skipped: Callable | None = None
    active: Callable | None = None
    invalid: str = "error"
    nothing: str = "not_found"


def known_vocabulary(name: str, edges: DataFrame, nodes: DataFrame | None = None) -> Vocabulary:
    """GO, HPO, NCI, LCH_NW, LNC or SNOMEDCT_US (or its _V2) over a release's edges (child, parent, perhaps pos), with its own way up and limits.

    nodes: code, and for SNOMEDCT_US active. Codes of NCI, LNC and LCH_NW that no edge names have a path of one node, whether the vocabulary knows
    them or not (names tell which); of the others only known ones have. Where nodes are told, LCH_NW's parents have to be
    known, and SNOMEDCT_US's codes active.
    """
    base = name.removesuffix("_V2")
    known = None if nodes is None else nodes.select("code").distinct() if "active" not in nodes.columns else nodes.where("active").select("code").distinct()
    upper = edges if known is None or base != "LCH_NW" else edges.join(known.withColumnRenamed("code", "parent"), "parent", "left_semi")

    def lone(rows: DataFrame, paths: DataFrame) -> DataFrame:
        """paths and those of known codes that no edge names."""
        return paths if known is None else hierarchy.with_unknown(rows.join(known, "code", "left_semi"), paths, upper, "")

    def started(rows: DataFrame) -> DataFrame:
        return rows if known is None else rows.join(known, "code", "left_semi")

    ways = {
        "GO": lambda rows: lone(rows, traversal.first_paths(rows, upper).select("code", "path")),
        "HPO": lambda rows: lone(rows, traversal.first_paths(rows, upper).select("code", "path")),
        "NCI": lambda rows: hierarchy.with_unknown(rows, traversal.bounded_paths(rows, upper, traversal.NODE_PATHS).select("code", "path"), upper, ""),
        "LNC": lambda rows: hierarchy.with_unknown(rows, traversal.bounded_paths(rows, upper, traversal.FEW_NODE_PATHS).select("code", "path"), upper, ""),
        "LCH_NW": lambda rows: hierarchy.with_unknown(rows, traversal.bounded_paths(rows, upper, traversal.MOST_PATHS, root_fallback=True).select("code", "path"), upper, ""),
        "SNOMEDCT_US": lambda rows: lone(rows, traversal.expanded_paths(started(rows), upper).select("code", "path")),
    }
    return Vocabulary(name, lambda c: code_forms.valid(F.lit(base), c), ways[base], code_forms.loinc_skipped if base == "LNC" else None)


def extract_paths(spark: SparkSession, crosswalk: DataFrame, vocabularies: list[Vocabulary], aliases: DataFrame, out: str, batches: int = 1, most_errors: int | None = None) -> DataFrame:
    """Paths of every concept's codes, vocabulary by vocabulary, appended to out/paths; concepts that a run before did are left. Returns the status of each code.

    crosswalk: cui, sab, code; aliases: vocab, sab, prio. A vocabulary whose paths can't be computed raises; a code
    without a valid form is an error in the status, not in the run. Concepts go in batches, by hash; once most_errors codes
    of a vocabulary are errors, its other batches are left for another run. Statuses are appended to out/status, and counts, gathered while
    they are written, to out/ledger; out/statistics tells of all runs so far.
    """
    codes = cut_lineage(concepts.alias_lookup(crosswalk.select("cui", "sab", "code"), aliases), "codes")
    run, written = time.time_ns(), []
    for v in vocabularies:
        todo = codes.where(F.col("vocab") == v.name).select("cui", "code")
        before = sinks.paths_of(spark, out, v.name)
        todo = cut_lineage(todo if before is None else hierarchy.resume(todo, before), f"todo-{v.name}")
        errors = 0
        for batch in range(batches):
            if most_errors is not None and errors >= most_errors:
                break
            counts, status = _extracted(todo.where(F.pmod(F.xxhash64("cui"), F.lit(batches)) == batch), v, out, run)
            written.append(status)
            errors += counts["errors"]
            row = {"run": run, "vocab": v.name, "batch": batch, "stopped": most_errors is not None and errors >= most_errors and batch + 1 < batches} | counts
            sinks.append_json(spark.createDataFrame([row]), f"{out.rstrip('/')}/ledger")
    sinks.statistics_json(run_statistics(spark, out), f"{out.rstrip('/')}/statistics")
    return reduce(DataFrame.unionByName, written).drop("run")


def _extracted(todo: DataFrame, v: Vocabulary, out: str, run: int) -> tuple[dict[str, int], DataFrame]:
    """Writes paths and statuses of some concepts; returns what was counted meanwhile, and the statuses."""
    taken = v.valid(F.col("code")) if v.skipped is None else v.valid(F.col("code")) & ~v.skipped(F.col("code"))
    paths = cut_lineage(v.paths(todo.where(taken).select("code").distinct()), f"paths-{v.name}")
    status = hierarchy.code_status(todo, paths, v.valid(F.col("code")), v.active and v.active(F.col("code")), v.skipped and v.skipped(F.col("code")), v.invalid, v.nothing)
    lengths, seen = Observation(), Observation()
    rows = todo.join(paths, "code").withColumn("vocab", F.lit(v.name))
    size = F.size("path")
    sinks.paths_table(rows.observe(lengths, F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum(size), F.lit(0)).alias("nodes"), F.coalesce(F.max(size), F.lit(0)).alias("longest")), f"{out.rstrip('/')}/paths")
    told = F.col("status")
    counted = {"codes": F.count(F.lit(1)), "success": F.count_if(told == "success"), "errors": F.count_if(told == v.invalid), "inactive": F.count_if(told == "inactive"), "nothing": F.count_if(told == v.nothing), "skipped_mthu": F.count_if(told == "skipped_mthu")}
    status = cut_lineage(status.withColumns({"vocab": F.lit(v.name), "run": F.lit(run)}).observe(seen, *[c.alias(k) for k, c in counted.items()]), "status")
    status.write.mode("append").partitionBy("vocab").parquet(f"{out.rstrip('/')}/status")
    return {k: int(x or 0) for k, x in {**seen.get, **lengths.get}.items()}, status


def run_statistics(spark: SparkSession, out: str) -> DataFrame:
    """Statistics by vocabulary over all runs; of a code that several runs tried the last status counts, so runs that go on where one stopped tell the same as one run."""
    rows = spark.read.parquet(f"{out.rstrip('/')}/status")
    last = rows.groupBy("vocab", "cui", "code").agg(F.max_by(F.struct("n_paths", "status"), "run").alias("x"))
    return statistics.run_report(last.select("vocab", "cui", "code", "x.*"))


def read_processed(spark: SparkSession, folder: str, names: list[str], suffix: str = "") -> DataFrame:
    """A row a mention of what process_corpora has written (or of files that lie in the dataset's own folder); datasets without a file are left out, and none at all raises."""
    places = lambda n: (f"{folder.rstrip('/')}/{n}{suffix}/documents", f"{folder.rstrip('/')}/{n}{suffix}")
    found = [next((x for at in places(n) if (x := processed.processed(spark, at, n)) is not None), None) for n in names]
    found = [x for x in found if x is not None]
    if not found:
        raise FileNotFoundError(f"no processed corpus in {folder}")
    return processed.mentions_of(reduce(DataFrame.unionByName, found))


def summarise(spark: SparkSession, folder: str, names: list[str], suffix: str = "") -> DataFrame:
    """Statistics by dataset over processed corpora."""
    return statistics.rates(statistics.basic(read_processed(spark, folder, names, suffix), ["dataset"]))


def summarise_all(spark: SparkSession, folder: str, names: list[str], suffix: str = "") -> DataFrame:
    """Statistics by dataset and, in a row of their own, of all datasets together."""
    return statistics.rates(statistics.rollup(read_processed(spark, folder, names, suffix)))
