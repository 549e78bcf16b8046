"""Mentions: from annotations to rows, and from rows to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify_token(token: Column) -> Column:
    """(sab, code) of a composite id's token; null for none."""
    t = F.trim(token)
    return (
        F.when((t == "") | (t == "-"), F.lit(None))
        .when(t.startswith("OMIM:"), F.struct(F.lit("OMIM").alias("sab"), F.substring(t, 6, 100).alias("code")))
        .when(t.rlike("^[Dd][0-9]+$"), F.struct(F.lit("MSH").alias("sab"), F.upper(t).alias("code")))
        .when(t.rlike("^[0-9]+$"), F.struct(F.lit("OMIM").alias("sab"), t.alias("code")))
        .otherwise(F.struct(F.lit("MSH").alias("sab"), t.alias("code")))
    )


def split_policy(rows: DataFrame, concept: str = "concept") -> DataFrame:
    """One mention a segment of a `|` list if all segments are single ids of one source; else one with all candidates in order."""
    found = F.filter(F.transform(F.split(F.col(concept), r"[|+]"), classify_token), lambda x: x.isNotNull())
    several = ~F.col(concept).contains("+") & (F.size("_found") == F.size(F.split(F.col(concept), r"\|"))) & (F.size(F.array_distinct(F.transform("_found", lambda x: x["sab"]))) == 1)
    groups = F.when(several, F.transform("_found", lambda x: F.array(x))).otherwise(F.array("_found"))
    out = rows.withColumn("_found", found).withColumn("_groups", groups).select("*", F.posexplode("_groups").alias("part", "candidates"))
    return out.drop("_found", "_groups").withColumn("sab", F.try_element_at("candidates", F.lit(1))["sab"]).withColumn("code", F.try_element_at("candidates", F.lit(1))["code"])


def explode_ids(rows: DataFrame, concept: str = "concept") -> DataFrame:
    """A mention an id of a `|` list; without any, the mention as it is."""
    ids = F.filter(F.split(F.col(concept), r"\|"), lambda x: (F.trim(x) != "") & (F.trim(x) != "-"))
    return rows.select("*", F.posexplode(F.when(F.size(ids) > 0, ids).otherwise(F.array(concept))).alias("part", "native_id"))


def explode_spans(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """A row a span `start-end` of a comma list; ill-formed ones go."""
    out = rows.select("*", F.posexplode(F.split(F.col(spans), ",")).alias("part", "_span"))
    number = lambda k: F.try_element_at(F.split("_span", "-"), F.lit(k)).try_cast("int")
    return out.withColumn("start", number(1)).withColumn("end", number(2)).where("start is not null and end > start").drop("_span")


def merge_spans(first: DataFrame, second: DataFrame, on: tuple[str, ...] = ("doc_id", "start", "end")) -> DataFrame:
    """Two annotation sets on one span key; of several on a span the last counts (by pos). The first set's id comes first."""
    last = lambda df, name: df.groupBy(*on).agg(F.max_by("native_id", "pos").alias(name))
    return last(first, "first_id").join(last(second, "second_id"), list(on), "full_outer").withColumn("native_id", F.coalesce("first_id", "second_id"))


def to_documents(mentions: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Documents with their mentions nested in order. Documents without a mention don't come to be."""
    return mentions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("mentions"))


def section_offsets(sections: DataFrame, doc: str, pos: str, text: str, gap: int = 2) -> DataFrame:
    """Adds `offset`, where each section begins when a document's sections are joined with `gap` characters."""
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)))


def valid_spans(rows: DataFrame, text: str, start: str = "start", end: str = "end", mention: str = "mention") -> DataFrame:
    """Adds `in_range` and `matches`."""
    inside = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= F.length(text))
    return rows.withColumn("in_range", inside).withColumn("matches", inside & (F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)) == F.col(mention)))


def split_of(documents: DataFrame, members: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds `split` by membership lists (doc_id, split, prio): the first of train, dev, test; else unknown."""
    first = members.groupBy(doc_id).agg(F.min_by("split", "prio").alias("split"))
    return documents.join(first, doc_id, "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def with_notes(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotations with their notes' text and the text they cover; those of no note go."""
    return annotations.join(notes, "note_id").withColumn("mention", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
