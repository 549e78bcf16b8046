"""Statistics of linked documents. mentions: doc_id, start, end, text, native_id, native_ontology_name, cui, semantic_type ..."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HAS_CUI = "cui is not null and cui <> '' and cui <> 'CUI-less'"


def basic(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Numbers of documents, mentions, distinct texts, spans and concepts, mapped and unmapped.

    Each kind of thing is counted from its own grouping, whose rows are combined before the
    shuffle; several distinct counts at once would multiply every row.
    """
    by = by or []
    own = mentions.withColumn("_cui", F.expr(f"case when {HAS_CUI} then cui end"))
    kinds = {"spans": ["doc_id", "start", "end"], "texts": ["text"], "concepts": ["_cui"]}
    per_span = own.groupBy(*by, "doc_id", "start", "end").agg(F.count("*").alias("m"), F.count("_cui").alias("k"))
    per_doc = per_span.groupBy(*by, "doc_id").agg(F.sum("m").alias("m"), F.sum("k").alias("k"), F.count("*").alias("spans"))
    full = F.col("doc_id").isNotNull()
    out = per_doc.groupBy(*by).agg(F.count_if(full).alias("documents"), F.coalesce(F.sum("m"), F.lit(0)).alias("mentions"), F.coalesce(F.sum(F.when(full, F.col("spans"))), F.lit(0)).alias("spans"), F.coalesce(F.sum("k"), F.lit(0)).alias("mapped"))
    for name in ("texts", "concepts"):
        (key,) = kinds[name]
        part = own.where(F.col(key).isNotNull()).select(*by, key).distinct().groupBy(*by).agg(F.count("*").alias(name))
        out = out.join(part, by, "left") if by else out.crossJoin(F.broadcast(part))  # one row
    return out.select(*by, "documents", "mentions", F.coalesce("texts", F.lit(0)).alias("texts"), "spans", F.coalesce("concepts", F.lit(0)).alias("concepts"), "mapped", (F.col("mentions") - F.col("mapped")).alias("unmapped"))


def rollup(mentions: DataFrame) -> DataFrame:
    """basic() of each dataset and, with everything true and no dataset, of all of them together. mentions: dataset and the columns that basic() reads.

    One look at the mentions: what they name (a document, a span, a text, a concept) is reduced to distinct
    names by dataset, and these are counted by dataset and altogether at once, each name once. Documents
    and spans of two datasets are never the same; texts and concepts may be.
    """
    word = lambda c: F.col(c).cast("string")
    nothing = F.lit(None).cast("string")
    own = mentions.withColumn("_cui", F.expr(f"case when {HAS_CUI} then cui end"))
    named = lambda kind, there, *parts: F.when(there, F.struct(F.lit(kind).alias("kind"), *[p.alias(f"p{k}") for k, p in enumerate([*parts, *[nothing] * (4 - len(parts))])]))
    doc = F.col("doc_id").isNotNull()
    things = F.array(
        named("documents", doc, word("dataset"), word("doc_id")),
        named("spans", doc, word("dataset"), word("doc_id"), word("start"), word("end")),
        named("texts", F.col("text").isNotNull(), word("text")),
        named("concepts", F.col("_cui").isNotNull(), word("_cui")),
        named("mentions", F.lit(True)),
    )
    each = own.select("dataset", F.col("_cui").isNotNull().cast("long").alias("k"), F.explode(F.array_compact(things)).alias("thing"))
    each = each.groupBy("thing", "dataset").agg(F.count("*").alias("m"), F.sum("k").alias("k"))
    # a name's datasets, of which the first counts it for all
    listed = each.groupBy("thing").agg(F.collect_list(F.struct("dataset", "m", "k")).alias("d")).select(F.col("thing.kind").alias("kind"), F.posexplode("d").alias("at", "d"))
    sets = listed.select("kind", "d.*", (F.col("at") == 0).cast("long").alias("new")).groupingSets([["kind", "dataset"], ["kind"]], "kind", "dataset")
    counts = sets.agg(F.grouping("dataset").alias("all"), F.count("*").alias("n"), F.sum("new").alias("once"), F.sum("m").alias("m"), F.sum("k").alias("k"))
    counts = counts.withColumn("distinct", F.when(F.col("all") == 1, F.col("once")).otherwise(F.col("n")))
    of = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    out = counts.groupBy("dataset", "all").agg(of("documents", "distinct").alias("documents"), of("mentions", "m").alias("mentions"), *[of(c, "distinct").alias(c) for c in ("texts", "spans", "concepts")], of("mentions", "k").alias("mapped"))
    return out.select("dataset", (F.col("all") == 1).alias("everything"), "documents", "mentions", "texts", "spans", "concepts", "mapped", (F.col("mentions") - F.col("mapped")).alias("unmapped"))


def mapping_improvements(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Numbers of mentions with a concept that had no id (or one that says nothing), an id that says there is none, another concept's id, or no id at all.

    mentions: native_id, cui.
    """
    native, found = F.coalesce(F.col("native_id"), F.lit("")), F.coalesce(F.col("cui"), F.lit("")) != ""
    return mentions.groupBy(*(by or [])).agg(
        F.count_if(found & native.isin("", "nan", "NULL", "null")).alias("originally_no_concept"),
        F.count_if(found & F.upper(native).isin("CUI-LESS", "CUILESS", "CUI LESS")).alias("originally_cui_less"),
        F.count_if(found & native.startswith("C") & (native != F.col("cui"))).alias("cui_validation_success"),
        F.count_if(found & (native == "")).alias("fallback_success"),
    )


def nothing_said(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Numbers of mentions whose concept says that there is none, and of those without any concept."""
    less = F.lower(F.regexp_replace("cui", "_", "-")).isin("cui-less", "cuiless")
    return mentions.groupBy(*(by or [])).agg(F.count_if(less).alias("cui_less"), F.count_if(F.coalesce(F.col("cui"), F.lit("")) == "").alias("no_concept"))


def concept_types(types: DataFrame) -> DataFrame:
    """cui, tuis: all its types, each once, in order of appearance (pos)."""
    first = types.groupBy("cui", "tui").agg(F.min("pos").alias("pos"))
    return first.groupBy("cui").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tui"))), lambda x: x["tui"]).alias("tuis"))


def term_type_counts(codes: DataFrame, k: int = 5) -> DataFrame:
    """Of each source the codes by term type (of a joined list, each counts), how many types there are, and the k most frequent (`TYPE=n`)."""
    counts = codes.select("sab", F.explode(F.split("tty", r"\|")).alias("tty")).where(F.trim("tty") != "").groupBy("sab", F.trim("tty").alias("tty")).agg(F.count("*").alias("n"))
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tty"))), 1, k), lambda x: F.concat(x["tty"], F.lit("="), -x["less"]))
    return counts.groupBy("sab").agg(F.sum("n").alias("codes"), F.count("*").alias("types"), F.array_join(best, " ").alias("top"))


def mapping_summary(used: DataFrame, codes: DataFrame, types: DataFrame, dataset: str) -> DataFrame:
    """One row: concepts, those with types and with codes, sources, types, codes, and what share the first two are."""
    a = used.agg(F.count_distinct("cui").alias("concepts"))
    b = codes.agg(F.count_distinct("cui").alias("with_codes"), F.count("*").alias("codes"), F.array_join(F.array_sort(F.collect_set("sab")), " ").alias("sources"))
    c = types.agg(F.count_distinct("cui").alias("with_types"), F.array_join(F.array_sort(F.collect_set("tui")), " ").alias("types"))
    rows = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    of = lambda x: F.coalesce(F.try_divide(x, "concepts"), F.lit(0.0))
    return rows.select(F.lit(dataset).alias("dataset"), "*", of("with_codes").alias("codes_coverage"), of("with_types").alias("types_coverage"))


#: Kinds of errors by what their message holds.
ERROR_KINDS = (("timeout", "timeout"), ("404", "not_found"), ("not found", "not_found"), ("429", "rate_limit"), ("rate", "rate_limit"), ("400", "invalid"), ("invalid", "invalid"))


def error_kind(message):
    """The kind of an error, by the first word of ERROR_KINDS that its message holds; else other."""
    lower = F.lower(message)
    found = F.lit("other")
    for word, kind in reversed(ERROR_KINDS):
        found = F.when(lower.contains(word), kind).otherwise(found)
    return F.when(message.isNotNull(), found)


def vocabulary_statistics(status: DataFrame) -> DataFrame:
    """Of each vocabulary: concepts, codes, codes with paths and their share, paths, and mean and deviation of paths a code. status: vocab, cui, code, n_paths, status."""
    found = F.col("status") == "success"
    out = status.groupBy("vocab").agg(
        F.count_distinct("cui").alias("concepts"), F.count("*").alias("codes"), F.count_if(found).alias("with_paths"), F.sum("n_paths").alias("paths"),
        F.avg(F.when(found, F.col("n_paths"))).alias("mean_paths"), F.stddev_pop(F.when(found, F.col("n_paths"))).alias("deviation"),
        F.count_if(F.col("status").isin("error", "invalid")).alias("errors"), F.count_if(F.col("status").isin("not_found", "no_data")).alias("not_found"), F.count_if(F.col("status") == "inactive").alias("inactive"),
        F.count_if(F.col("status") == "skipped_mthu").alias("skipped_mthu"),
    )
    return out.withColumn("coverage", F.coalesce(F.try_divide("with_paths", "codes"), F.lit(0.0)))


def run_report(status: DataFrame) -> DataFrame:
    """vocabulary_statistics() with rates: of concepts with paths, errors, and paths a concept."""
    hit = status.groupBy("vocab", "cui").agg(F.max("n_paths").alias("n")).groupBy("vocab").agg(F.count_if(F.col("n") > 0).alias("concepts_with_paths"))
    of = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = vocabulary_statistics(status).join(hit, "vocab")
    return rows.withColumns({"concept_success_rate": of("concepts_with_paths", "concepts"), "error_rate": of("errors", "codes"), "paths_a_concept": of("paths", "concepts")})


def cleaning_report(rows: DataFrame, kind: str = "entity_type", start: str = "start") -> DataFrame:
    """Of each kind of mention how many were found again after cleaning (start 0 or more), how many not, and the percentage."""
    ok = F.coalesce(F.col(start) >= 0, F.lit(False))
    return rows.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(ok).alias("found"), F.count_if(~ok).alias("lost"), F.round(100 * F.count_if(ok) / F.count("*"), 6).alias("percent"))


def stress_sample(concepts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n concepts, the same for the same seed, for a trial of the path stage."""
    return concepts.select("cui").distinct().orderBy(F.xxhash64(F.lit(seed), "cui"), "cui").limit(n)


def rates(stats: DataFrame) -> DataFrame:
    """Rates over basic(); 0 where there is nothing to divide by."""
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return stats.withColumn("mapping_rate", of("mapped", "mentions")).withColumn("mentions_a_document", of("mentions", "documents")).withColumn("mentions_a_concept", of("mapped", "concepts"))


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median (interpolated), least, greatest and deviation of the population."""
    return rows.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.stddev_pop(value).alias("deviation"))


def mapping_source(specific: str, general: str, native: str, cui: str):
    """How a mention came to its concept."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return (
        F.when(~has(cui), "unmapped")
        .when(has(specific) & (F.col(specific) == F.col(native)), "specific")
        .when(has(general) & (F.col(general) == F.col(native)), "general")
        .when(has(native) & F.col(native).startswith("C"), "cui_validation")
        .when(has(native), "ontology_id")
        .otherwise("text")
    )


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; of equal ones the smaller first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n over equal widths between the least and the greatest value; the last bin has its right edge."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = rows.select(F.col(value).alias("v")).where("v is not null").crossJoin(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, group: str) -> DataFrame:
    """Counts of a group, and percent of all."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def across(mentions: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Of each dataset its concepts, those no other has, and its share of all."""
    pairs = mentions.where(HAS_CUI).select(dataset, "cui").distinct()
    spread = pairs.groupBy("cui").agg(F.count("*").alias("in"), F.min(dataset).alias(dataset))
    only = spread.where("`in` = 1").groupBy(dataset).agg(F.count("*").alias("own"))
    total = spread.agg(F.count("*").alias("total"))
    out = pairs.groupBy(dataset).agg(F.count("*").alias("concepts")).join(only, dataset, "left").crossJoin(F.broadcast(total))  # one row
    return out.select(dataset, "concepts", F.coalesce("own", F.lit(0)).alias("own"), F.try_divide("concepts", "total").alias("coverage"))
