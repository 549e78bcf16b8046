"""How each corpus links its mentions: an ordered list of tries over one code index, then the text.

A try names a column and the source whose code it holds; `CONCEPT` stands for a
concept id that must have a semantic type, `UMLS` for one that must have a name.
All tries of all mentions are one equi-join with the index; the first that is
there counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import strip
from ..session import cut_lineage
from . import concepts

CONCEPT = "CONCEPT"
#: The sources that a SNOMED code is looked up in, in order.
SNOMED_SOURCES = ("SNOMEDCT_US", "SCTSPA", "SNOMEDCT", "SNOMEDCT_CORE")


@dataclass(frozen=True)
class Spec:
    """tries: (column, source) in order; a source of None is read from `ontology`. candidates: a column of (sab, code) that takes the place of the tries where it isn't empty."""

    tries: tuple[tuple[str, str | None], ...]
    candidates: str | None = None
    ontology: str = "native_ontology_name"
    retype: bool = False

    @property
    def columns(self) -> list[str]:
        own = [c for c, _ in self.tries] + [self.ontology] * any(s is None for _, s in self.tries)
        return list(dict.fromkeys([*own, *([self.candidates] if self.candidates else []), "text"]))


_SNOMED = lambda column: tuple((column, s) for s in SNOMED_SOURCES)
SPECS = {
    "cdr": Spec((("native_id", None),)),
    "ncbi": Spec((("concept_id", CONCEPT), ("native_id", None)), candidates="candidates"),
    "medmentions": Spec((("cui", CONCEPT),), retype=True),
    "cadec": Spec((*_SNOMED("snomed_id"), ("meddra_id", "MDR"))),
    "cometa": Spec((*_SNOMED("specific_id"), ("specific_id", CONCEPT), *_SNOMED("general_id"), ("general_id", CONCEPT))),
    "adr": Spec((("native_id", "MDR"),)),
    "mantra": Spec((("native_id", CONCEPT),)),
    "mimic": Spec((("native_id", "SNOMEDCT_US"),)),
    "share": Spec((("native_id", CONCEPT),)),
}


def _keys(sab: Column, code: Column, prio: int | Column) -> Column:
    """The index keys of a try, in turn: a concept id as it is, a code in its normal form and its source's habits."""
    place = F.lit(prio) if isinstance(prio, int) else prio
    bare = strip(code)
    concept = F.when(bare.startswith("C") & (F.length(bare) >= 7), F.array(F.struct((place * 10).alias("prio"), F.lit(CONCEPT).alias("sab"), bare.alias("code"))))
    native = codes.cleaned(code, cut_at_dot=True)
    usable = native.isNotNull() & ~F.lower(code).isin("nan", "-", *codes.CONCEPT_LESS)
    # a concept id under UMLS is looked up by its name alone
    ladder = F.transform(codes.ladder(sab, native), lambda x: F.struct((place * 10 + x["prio"]).alias("prio"), sab.alias("sab"), x["code"].alias("code")))
    none = F.array().cast("array<struct<prio:int,sab:string,code:string>>")
    return F.coalesce(F.when(sab == CONCEPT, concept).when(usable & sab.isNotNull(), ladder), none)


def code_keys(atoms: DataFrame, types: DataFrame) -> DataFrame:
    """sab, code, cui: the code index, and concepts with a semantic type (CONCEPT) or a name (UMLS) under their own id."""
    typed = types.select(F.lit(CONCEPT).alias("sab"), F.col("cui").alias("code"), "cui").distinct()
    named = concepts.preferred_names(atoms).where("name is not null").select(F.lit("UMLS").alias("sab"), F.col("cui").alias("code"), "cui")
    return concepts.code_index(atoms.where("sab not in ('UMLS', 'CONCEPT')")).unionByName(typed).unionByName(named)


def link(mentions: DataFrame, atoms: DataFrame | concepts.Indexes, types: DataFrame, spec: Spec) -> DataFrame:
    """mentions with linked (concept or '') and method: native_id_mapping, exact_match, semantic_containment or no_mapping.

    Distinct combinations of the spec's columns are linked once and joined back. With
    `retype`, semantic_type becomes the linked concept's first type, if it has one.
    """
    index = concepts.Indexes.of(atoms)
    combos = mentions.select(*spec.columns).distinct().withColumn("id", F.struct(*spec.columns))
    tries = F.flatten(F.array(*[_keys(F.col(spec.ontology) if s is None else F.lit(s), F.col(c), k) for k, (c, s) in enumerate(spec.tries)]))
    if spec.candidates:
        given = F.flatten(F.transform(F.col(spec.candidates), lambda x, k: _keys(x["sab"], x["code"], F.lit(len(spec.tries)) + k)))
        # candidates take the place of all but the concept's own try
        own = F.filter(tries, lambda x: x["sab"] == CONCEPT)
        tries = F.when(F.size(spec.candidates) > 0, F.concat(own, given)).otherwise(tries)
    keys = combos.select("id", F.explode(tries).alias("t")).select("id", "t.prio", "t.sab", "t.code")
    native = keys.join(code_keys(index.atoms, types), ["sab", "code"]).groupBy("id").agg(F.min_by("cui", "prio").alias("native"))
    seen = cut_lineage(combos.join(native, "id", "left").select("id", "text", "native"), "combos")
    by_text = concepts.link_texts(seen.where("native is null and text <> '' and lower(text) <> 'nan'").select("text").distinct(), index)
    found = seen.join(by_text, "text", "left").select("id", F.coalesce("native", "cui").alias("linked"), F.when(F.col("native").isNotNull(), "native_id_mapping").otherwise(F.coalesce("method", F.lit("no_mapping"))).alias("method"))
    out = mentions.withColumn("id", F.struct(*spec.columns)).join(found, "id", "left").drop("id")
    out = out.withColumn("linked", F.coalesce("linked", F.lit("")))
    if spec.retype:
        first = concepts.first_types(types).select(F.col("cui").alias("linked"), F.col("tui").alias("_tui"))
        out = out.join(first, "linked", "left").withColumn("semantic_type", F.coalesce("_tui", "semantic_type")).drop("_tui")
    return out
