"""Code formats of vocabularies, and normal forms of codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a code of each vocabulary looks like.
FORMATS = {
    "SNOMEDCT_US": r"^[0-9]{6,18}$",
    "MSH": r"^[A-Z][0-9]{6,9}$",
    "NCI": r"^[Cc][0-9]+$",
    "LNC": r"^([0-9]{4,}-[0-9]|MTHU[0-9]{6}|(LP|LA|LL)[0-9]{4,}-[0-9]|LG[0-9]{5}-[0-9])$",
    "MDR": r"^[0-9]{8}$",
    "NCBI": r"^[0-9]+$",
    "GO": r"^GO:[0-9]{7}$",
    "HPO": r"^HP:[0-9]{7}$",
    "LCH_NW": r"^((sh|n|nb|no|nr|gf|fst)[0-9]+|[A-Za-z0-9]{4,})$",
    "ICD10CM": r"^([A-Z][0-9]{2}(\.[0-9]{1,4})?|[A-Z][0-9]{2}[A-Z](\.[0-9]{1,3})?|[A-Z][0-9]{2}-[A-Z][0-9]{2}|[A-Z][0-9][A-Z](\.[0-9]{1,3})?|[A-Z][0-9]{2}[XYZ]([0-9]|\.[XYZ][0-9]?[A-Z]?)?)$",
    "ICD9CM": r"^([0-9]{3}(\.[0-9]{1,2})?|V[0-9]{2}(\.[0-9]{1,2})?|E[0-9]{3,4}(\.[0-9])?|[0-9]{3}-[0-9]{3}(\.99)?|[EV][0-9]{2,4}-[EV]?[0-9]{2,4}(\.9?9?)?|[0-9]{2}(\.[0-9]{1,2})?)$",
}
ICD = ("ICD10CM", "ICD9CM")
#: Spellings of "no concept" in lower case.
CONCEPT_LESS = ("concept-less", "conceptless", "concept_less", "cui-less", "cuiless", "cui_less")
CUI = r"^C[0-9]{7}$"


def valid(vocab: Column, code: Column) -> Column:
    """Whether a stripped code has its vocabulary's format; unknown vocabularies have none. An ICD code may have either revision's, and none that is excluded."""
    code = F.trim(code)
    pick = lambda found, item: found.when(vocab == item[0], code.rlike(item[1]))
    first, *rest = FORMATS.items()
    icd = ~icd_excluded(code) & (code.rlike(FORMATS["ICD10CM"]) | code.rlike(FORMATS["ICD9CM"]))
    found = reduce(pick, rest, F.when(vocab.isin(*ICD), icd).when(vocab == first[0], code.rlike(first[1]))).otherwise(False)
    return F.coalesce(found, F.lit(False))


def icd_excluded(code: Column) -> Column:
    """Chapter-like and range-like codes that are no diagnosis of their own."""
    return code.rlike(r"^[0-9]{2}\.[0-9]{1,2}$") | code.rlike(r"^[0-9]+-[0-9]+\.99$") | (code.rlike(r"^[0-9]{1,2}$") & ~code.isin("30", "50", "52", "53"))


def meddra_id(code: Column) -> Column:
    """A MedDRA id of five digits or more, else ''."""
    return F.when(F.trim(code).rlike("^[0-9]{5,}$"), F.trim(code)).otherwise("")


def loinc_skipped(code: Column) -> Column:
    return code.startswith("MTHU")


def cleaned(code: Column, cut_at_dot: bool = False) -> Column:
    """A stripped code without a number's `.0`; with `cut_at_dot`, without anything from a dot on. Shorter than 3: null."""
    c = F.trim(code)
    c = F.substring_index(c, ".", 1) if cut_at_dot else F.regexp_replace(c, r"\.0$", "")
    return F.when(F.length(c) >= 3, c)


def ladder(sab: Column, code: Column) -> Column:
    """Keys to try for a code in turn: as it is, then by its source's habits. An array of (prio, code)."""
    other = (
        F.when((sab == "MSH") & code.startswith("D"), F.substring(code, 2, 100))
        .when(sab == "MSH", F.concat(F.lit("D"), code))
        .when(sab == "SNOMEDCT_US", F.ltrim(code, F.lit("0")))
        .when(sab == "MDR", code.try_cast("bigint").cast("string"))
    )
    return F.filter(F.array(F.struct(F.lit(0).alias("prio"), code.alias("code")), F.struct(F.lit(1).alias("prio"), other.alias("code"))), lambda x: x["code"].isNotNull() & (x["code"] != ""))


def conceptless(code: Column) -> Column:
    """Whether a code says that there is no concept."""
    return F.upper(F.regexp_replace(code, "[_-]", "-")).isin("CUI-LESS", "CUILESS", "CONCEPT-LESS", "CONCEPTLESS", "NONE", "NULL")
