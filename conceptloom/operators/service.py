"""The concept service's questions, over a store of sorted tables instead of a remote interface.

The store holds a release's atoms sorted by concept, by source and code, and by folded name, and the types by
concept. A question about one concept, code or name is a filter that Parquet gets pushed down, and
since the tables are sorted it skips all but a few row groups. Questions about many are joins of a table of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import folded
from ..session import cut_lineage
from . import concepts, search

_NO_KEY = ("", "nan")


def concept_id(cui):
    """A concept id as the service takes it: stripped, with its C; null for none."""
    bare = F.trim(cui)
    return F.when(bare.isin(*_NO_KEY), None).when(bare.startswith("C"), bare).otherwise(F.concat(F.lit("C"), bare))


class ConceptService:
    """Questions about a release that build() has written. Every answer is a DataFrame; what has no answer has no row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, atoms: DataFrame, types: DataFrame, path: str) -> "ConceptService":
        """Writes the store. atoms: cui, lat, ispref, sab, tty, code, str, line_no; types: cui, tui, pos."""
        path = path.rstrip("/")
        atoms = atoms.select("cui", "lat", "ispref", "sab", "tty", "code", "str", "line_no")

        def put(rows: DataFrame, name: str, *keys: str) -> None:
            rows.repartitionByRange(*keys, F.xxhash64(*rows.columns)).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")

        put(atoms, "by_concept", "cui", "line_no")
        put(concepts.code_index(atoms.where(~F.col("code").isin(*concepts.EMPTY_CODES))), "by_code", "sab", "code")
        put(concepts.name_index(atoms), "by_name", "name")
        put(types.select("cui", "tui", "pos"), "types", "cui", "pos")
        return cls(atoms.sparkSession, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def atoms(self, cui: str) -> DataFrame:
        """All atoms of a concept, in order."""
        return self._table("by_concept").where(F.col("cui") == self._id(cui)).orderBy("line_no")

    def _id(self, cui: str | None) -> str | None:
        bare = (cui or "").strip()
        return None if bare in _NO_KEY else bare if bare.startswith("C") else f"C{bare}"

    def validate(self, cui: str) -> DataFrame:
        """cui, if there is such a concept."""
        return self._table("by_concept").where(F.col("cui") == self._id(cui)).select("cui").limit(1)

    def name(self, cui: str) -> DataFrame:
        """cui, name: the preferred name."""
        return concepts.preferred_names(self.atoms(cui))

    def closest_name(self, cui: str, text: str) -> DataFrame:
        """cui, name: of the concept's names the one nearest to a text."""
        key = self._table("by_concept").where(F.col("cui") == self._id(cui)).select("cui").limit(1).select(F.lit(0).alias("id"), "cui", F.lit(text).alias("text"))
        return concepts.closest_synonym(key, self.atoms(cui)).select(F.lit(self._id(cui)).alias("cui"), "name")

    def types(self, cui: str) -> DataFrame:
        """tui, pos: the semantic types in order, each once."""
        return self._table("types").where(F.col("cui") == self._id(cui)).groupBy("tui").agg(F.min("pos").alias("pos")).orderBy("pos")

    def codes(self, cui: str) -> DataFrame:
        """sab, codes: each source's distinct codes of a concept."""
        return self.atoms(cui).where("sab <> '' and code <> ''").groupBy("sab").agg(F.array_sort(F.collect_set("code")).alias("codes"))

    def codes_with_terms(self, cui: str) -> DataFrame:
        """sab, code, tty, term of a concept's atoms."""
        return concepts.term_types(self.atoms(cui).where("sab <> '' and code <> ''")).drop("cui")

    def concept_of_code(self, code: str, sab: str) -> DataFrame:
        """cui: the concept of a code under its source's spellings, in their order."""
        tries = self.spark.range(1).select(F.explode(codes.ladder(F.lit(sab), codes.cleaned(F.lit(code), cut_at_dot=True))).alias("t")).select("t.*").collect()  # a few spellings
        rows = self._table("by_code").where((F.col("sab") == sab) & F.col("code").isin(*[t["code"] for t in tries]))
        if not tries:
            return rows.select("cui").limit(0)
        return rows.orderBy(F.coalesce(*[F.when(F.col("code") == t["code"], t["prio"]) for t in tries])).select("cui").limit(1)

    def concept_of_text(self, text: str) -> DataFrame:
        """cui, method: by exact name, else by the search for words."""
        name = self.spark.range(1).select(folded(F.lit(text)).alias("n")).first()["n"]
        exact = self._table("by_name").where((F.col("name") == name) & (F.col("name") != "")).select("cui", F.lit("exact_match").alias("method")).limit(1)
        if not exact.isEmpty():
            return exact
        asked = self.spark.createDataFrame([(text,)], "text string")
        return search.search_words(asked.select(F.lit(0).alias("id"), "text"), self.word_index()).select("cui", F.lit("semantic_containment").alias("method"))

    def word_index(self) -> search.WordIndex:
        """The inverted index over the store's names, made once a service."""
        if not hasattr(self, "_words"):
            self._words = search.WordIndex(self._table("by_concept"))
        return self._words

    def records(self, cuis: DataFrame) -> DataFrame:
        """cui, valid, name, types, codes (of cui) for many concepts at once, each once; what isn't valid has null and empty lists."""
        asked = cut_lineage(cuis.select(concept_id(F.col("cui")).alias("cui")).where("cui is not null").distinct(), "asked")
        own = cut_lineage(self._table("by_concept").join(asked, "cui", "left_semi"), "atoms")
        listed = own.where("sab <> '' and code <> ''").select("cui", F.concat_ws(":", "sab", "code").alias("c")).distinct().groupBy("cui").agg(F.array_sort(F.collect_list("c")).alias("codes"))
        types = self._table("types").join(asked, "cui", "left_semi").groupBy("cui", "tui").agg(F.min("pos").alias("pos")).groupBy("cui").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tui"))), lambda x: x["tui"]).alias("types"))
        rows = asked.join(concepts.preferred_names(own), "cui", "left").join(own.select("cui", F.lit(True).alias("valid")).distinct(), "cui", "left").join(types, "cui", "left").join(listed, "cui", "left")
        valid = F.coalesce("valid", F.lit(False))
        none = F.array().cast("array<string>")
        return rows.select("cui", valid.alias("valid"), "name", F.when(valid, F.coalesce("types", none)).otherwise(none).alias("types"), F.coalesce("codes", none).alias("codes"))

    def concepts_of_codes(self, keys: DataFrame) -> DataFrame:
        """keys (sab, code, distinct) with the cui of each that has one."""
        rows = keys.withColumn("id", F.struct("sab", "code")).select("id", "sab", codes.cleaned(F.col("code"), cut_at_dot=True).alias("code")).where("code is not null")
        return concepts.link_codes(rows, self._table("by_code")).select("id.sab", "id.code", "cui")

    def write_mappings(self, cuis: DataFrame, folder: str, dataset: str) -> None:
        """The four files of the concepts of a dataset."""
        from ..sources import sinks

        used = cuis.select(concept_id(F.col("cui")).alias("cui")).where("cui is not null").distinct()
        own = self._table("by_concept").join(used, "cui", "left_semi")
        sinks.crosswalk_files(concepts.term_types(own.where("sab <> '' and code <> ''")), self._table("types"), used, dataset, folder)
