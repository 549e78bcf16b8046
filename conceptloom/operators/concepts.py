"""Concept indexes over atoms, and the linking cascade.

atoms: cui, lat, ispref, sab, tty, code, str, line_no. Whatever comes first or
last goes by line_no.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes
from ..functions.text import alnum, folded, tokens
from ..session import cut_lineage

PREFERRED = ("PT", "PN", "PF")
EMPTY_CODES = ("nan", "NULL", "null", "")


#: Sources whose atoms count, if no others are asked for.
ALLOWED_SOURCES = (
    "MSH", "SNOMEDCT_US", "RXNORM", "VANDF", "NDDF", "MTHSPL", "DRUGBANK", "NDFRT", "MMSL", "USPMG", "GS", "MTHMST", "NCBI",
    "OMIM", "HPO", "HGNC", "GO", "CHEBI", "MESH", "ICD10CM", "ICD9CM", "CPT", "HCPCS", "LOINC", "RADLEX", "FMA", "NCI",
    "MEDLINEPLUS", "UWDA", "AIR", "BI", "CCC", "CCPSS", "CCS", "CDT", "CHV", "COSTAR", "CPM", "CSP", "CST", "CVX", "DXP", "HCDT",
    "HCPT", "HL7V2.5", "HL7V3.0", "ICPC", "LCH", "LCH_NW", "LNC", "MCM", "MDDB", "MDREX", "MEDX", "NEWT", "NIC", "NOC", "NUCCPT",
    "OMS", "PCDS", "PDQ", "PSY", "QMR", "RAM", "RCD", "SNMI", "SNM", "SNOMED", "SOP", "SPN", "TKMT", "UMD", "WHO", "MDR",
)


def usable(atoms: DataFrame, sources: tuple[str, ...] | list[str] | None = ALLOWED_SOURCES) -> DataFrame:
    """Atoms of allowed sources (of all, if sources is None) with a code."""
    out = atoms.where(~F.col("code").isin(*EMPTY_CODES))
    return out if sources is None else out.where(F.col("sab").isin(*sources))


def code_index(atoms: DataFrame) -> DataFrame:
    """sab, code, cui: the first concept of a code."""
    return atoms.groupBy("sab", "code").agg(F.min_by("cui", "line_no").alias("cui"))


def name_index(atoms: DataFrame, preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """name, cui: a fold over a name's atoms in line order.

    The first atom is taken; a preferred atom (ispref Y) takes the place of one
    that isn't, else one with a preferred term type that of one without. The
    fold doesn't commute, so it runs over the ordered atoms of one name.
    """
    rows = atoms.where("lat = 'ENG'").groupBy(folded(F.col("str")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("line_no", "cui", F.coalesce(F.col("ispref") == "Y", F.lit(False)).alias("y"), F.coalesce(F.col("tty").isin(*preferred), F.lit(False)).alias("p")))).alias("a"))
    better = lambda now, new: (~now["y"] & new["y"]) | (~now["p"] & new["p"])
    return rows.select("name", F.aggregate(F.slice("a", 2, 1_000_000_000), F.element_at("a", 1), lambda now, new: F.when(better(now, new), new).otherwise(now))["cui"].alias("cui"))


def preferred_names(atoms: DataFrame) -> DataFrame:
    """cui, name: the last English name, else the first name."""
    english = F.when((F.col("lat") == "ENG") & (F.col("str") != ""), F.struct("line_no", "str"))
    return atoms.groupBy("cui").agg(F.coalesce(F.max(english)["str"], F.min_by("str", "line_no")).alias("name"))


def term_types(atoms: DataFrame, keys: tuple[str, ...] = ("cui", "sab", "code")) -> DataFrame:
    """Distinct term types in order of appearance, joined by |, and the last term."""
    first = atoms.groupBy(*keys, "tty").agg(F.min("line_no").alias("at"), F.max_by("str", "line_no").alias("term"), F.max("line_no").alias("last"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "tty"))), lambda x: x["tty"]), "|").alias("tty"), F.max_by("term", "last").alias("term"))


def crosswalk(atoms: DataFrame, used: DataFrame, sources: tuple[str, ...] | list[str] | None = ALLOWED_SOURCES) -> DataFrame:
    """cui, sab, code, tty, term: codes of the concepts used (cui) by their English atoms of allowed sources."""
    return term_types(usable(atoms, sources).where("lat = 'ENG'").join(used.select("cui").distinct(), "cui", "left_semi"))


def top_term_types(crosswalk: DataFrame, k: int = 5) -> DataFrame:
    """Of each source, the k most frequent term types (of a joined list, each counts)."""
    counts = crosswalk.select("sab", F.explode(F.split("tty", r"\|")).alias("tty")).groupBy("sab", "tty").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("sab").orderBy(F.desc("n"), "tty"))).where(F.col("rank") <= k)


def first_types(types: DataFrame) -> DataFrame:
    """cui, tui: the first semantic type."""
    return types.groupBy("cui").agg(F.min_by("tui", "pos").alias("tui"))


def valid_concepts(cuis: DataFrame, known: DataFrame) -> DataFrame:
    """Well-formed concepts that are known."""
    return cuis.where(F.col("cui").rlike(codes.CUI)).join(known.select("cui").distinct(), "cui", "left_semi")


def link_codes(keys: DataFrame, index: DataFrame, candidates: Column | None = None) -> DataFrame:
    """id, cui: the first of each key's candidates (prio, sab, code) that the code index has.

    keys: id and either `candidates` or sab and code, which are tried by their source's ladder.
    """
    if candidates is None:
        tries = keys.select("id", "sab", F.explode(codes.ladder(F.col("sab"), F.col("code"))).alias("c")).select("id", "sab", "c.prio", "c.code")
    else:
        tries = keys.select("id", F.explode(candidates).alias("c")).select("id", "c.prio", "c.sab", "c.code")
    return tries.join(index, ["sab", "code"]).groupBy("id").agg(F.min_by("cui", "prio").alias("cui"))


def link_names(keys: DataFrame, index: DataFrame) -> DataFrame:
    """id, cui by exact name. keys: id, text."""
    return keys.select("id", folded(F.col("text")).alias("name")).where("name <> ''").join(index, "name").select("id", "cui")


#: Symbols of the pieces by which a name that contains a text is looked up.
PIECE = 4


def contained_names(names: DataFrame) -> DataFrame:
    """n, n1, cui, line_no, nt: normal forms of English names, their first letter, and the concept, line and words of the first name of each."""
    named = names.where("lat = 'ENG'").select("cui", "line_no", alnum(F.col("str")).alias("n"), tokens(F.col("str")).alias("nt")).where("n <> ''")
    # of one normal form the first line stands; the letters shared are the same for all its names
    named = named.groupBy("n").agg(F.min_by(F.struct("cui", "line_no", "nt"), F.struct("line_no", "cui")).alias("x")).select("n", "x.*")
    return named.withColumn("n1", F.substring("n", 1, 1))


class Indexes:
    """What the cascade looks texts and codes up in, of one release of atoms. keep: each index is written once and serves every call, as for a stream or several corpora."""

    def __init__(self, atoms: DataFrame, keep: bool = True):
        self.atoms, self.keep = atoms, keep

    @classmethod
    def of(cls, atoms: "DataFrame | Indexes") -> "Indexes":
        return atoms if isinstance(atoms, cls) else cls(atoms, keep=False)

    def _made(self, index: DataFrame, tag: str) -> DataFrame:
        return cut_lineage(index, tag) if self.keep else index

    @cached_property
    def codes(self) -> DataFrame:
        return self._made(code_index(self.atoms), "code-index")

    @cached_property
    def names(self) -> DataFrame:
        return self._made(name_index(self.atoms), "name-index")

    @cached_property
    def preferred(self) -> DataFrame:
        """name, preferred: the first concept that is called so."""
        first = self.atoms.groupBy("cui").agg(F.min("line_no").alias("line_no")).join(preferred_names(self.atoms), "cui")
        return self._made(first.groupBy(F.lower("name").alias("name")).agg(F.min_by("cui", "line_no").alias("preferred")), "preferred")

    @cached_property
    def contained(self) -> DataFrame:
        return cut_lineage(contained_names(self.atoms), "names")

    def ready(self) -> "Indexes":
        """The same, with everything written."""
        _ = self.codes, self.names, self.preferred, self.contained
        return self


def link_contained(keys: DataFrame, names: "DataFrame | Indexes") -> DataFrame:
    """id, cui of the best English name that contains a text, or that it contains.

    keys: id, text; names: cui, lat, str, line_no. Names with the text's first letter count, or
    all names if none begins with it. Of a normal form its first name stands; names go by
    common tokens, then by nearness of length, two letters shared, and line.

    Both directions are equi-joins, whatever the number of names with one letter: names
    in a text by the text's own substrings of the names' lengths, names around a text
    by the rarest of its pieces of PIECE symbols; containment is then looked at.
    """
    texts = keys.select("id", alnum(F.col("text")).alias("t"), tokens(F.col("text")).alias("tt")).where("t <> ''")
    named = Indexes.of(names).contained
    letters = named.select(F.col("n1").alias("t1"), F.lit(True).alias("bucket")).distinct()
    bare = texts.select("t").distinct().withColumn("t1", F.substring("t", 1, 1)).join(letters, "t1", "left").select("t", "t1", F.coalesce("bucket", F.lit(False)).alias("bucket"))
    bare = cut_lineage(bare, "texts")
    lengths = named.select(F.length("n").alias("size")).distinct().agg(F.array_sort(F.collect_list("size")).alias("sizes"))  # one row, of the lengths that there are
    starts = F.filter(F.sequence(F.lit(1), F.length("t")), lambda p: ~F.col("bucket") | (F.substring("t", p, F.lit(1)) == F.col("t1")))
    fits = lambda p: F.transform(F.filter("sizes", lambda z: z <= F.length("t") - p + 1), lambda z: F.substring("t", p, z))
    within = bare.crossJoin(F.broadcast(lengths)).select("t", F.explode(F.array_distinct(F.flatten(F.transform(starts, fits)))).alias("n"))
    inside = within.join(named.select("n"), "n").select("t", "n")
    pieces = lambda c, z: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - z + 1, F.lit(1))), lambda p: F.substring(c, p, F.least(F.lit(z), F.length(c)))))
    around = []
    sizes = {r["z"] for r in bare.select(F.least(F.length("t"), F.lit(PIECE)).alias("z")).distinct().collect()}  # PIECE rows at most
    for z in sorted(sizes):  # texts shorter than a piece are one of their own length
        mine = bare.where(F.length("t") == z) if z < PIECE else bare.where(F.length("t") >= PIECE)
        grams = named.where(F.length("n") >= z).select("n", "n1", F.explode(pieces("n", z)).alias("g"))
        wanted = mine.select("t", "t1", "bucket", F.explode(pieces("t", z)).alias("g"))
        many = grams.join(wanted.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("many"))
        rarest = wanted.join(many, "g", "left").groupBy("t", "t1", "bucket").agg(F.min_by("g", F.struct(F.coalesce("many", F.lit(0)), F.col("g"))).alias("g"))
        hit = rarest.join(grams, "g").where(F.col("n").contains(F.col("t")) & (~F.col("bucket") | (F.col("n1") == F.col("t1"))))
        around.append(hit.select("t", "n"))
    pairs = reduce(DataFrame.unionByName, around, inside).distinct()
    rows = texts.join(pairs, "t").join(named.select("n", "cui", "line_no", "nt"), "n").join(bare.select("t", "bucket"), "t")
    apart = F.when(F.col("bucket") & (F.length("t") > 1), (F.substring("t", 1, 2) != F.substring("n", 1, 2)).cast("int")).otherwise(0)
    score = F.struct(-F.size(F.array_intersect("tt", "nt")), F.abs(F.length("n") - F.length("t")), apart, "line_no")
    return rows.groupBy("id").agg(F.min_by("cui", score).alias("cui"))


def link_texts(texts: DataFrame, atoms: "DataFrame | Indexes") -> DataFrame:
    """text, cui, method of what has one: the name index, then preferred names, then containment. texts: text, distinct."""
    rows = texts.withColumn("name", folded(F.col("text"))).where("name <> ''")
    index = Indexes.of(atoms)
    seen = rows.join(index.names.withColumnRenamed("cui", "exact"), "name", "left").join(index.preferred, "name", "left")
    seen = cut_lineage(seen.select("text", F.coalesce("exact", "preferred").alias("exact")), "texts-by-name")
    near = link_contained(seen.where("exact is null").select(F.col("text").alias("id"), "text"), index).select(F.col("id").alias("text"), F.col("cui").alias("near"))
    method = F.when(F.col("exact").isNotNull(), "exact_match").otherwise("semantic_containment")
    return seen.join(near, "text", "left").select("text", F.coalesce("exact", "near").alias("cui"), method.alias("method")).where("cui is not null")


def cascade(mentions: DataFrame, atoms: "DataFrame | Indexes") -> DataFrame:
    """mentions (sab, code, text) with cui and method: native code in its normal form, exact name, containment, none.

    Distinct combinations are linked once and joined back; each step only sees
    what the steps before left.
    """
    index = Indexes.of(atoms)
    keys = mentions.select("sab", "code", "text").distinct().withColumn("id", F.struct("sab", "code", "text"))
    usable_code = codes.cleaned(F.col("code"), cut_at_dot=True)
    native = link_codes(keys.select("id", "sab", usable_code.alias("code")).where("code is not null"), index.codes).select("id", F.col("cui").alias("native"))
    # one row a distinct combination, read by the steps below instead of being computed for each
    seen = cut_lineage(keys.join(native, "id", "left").select("sab", "code", "text", "native"), "keys")
    by_text = link_texts(seen.where("native is null and text <> ''").select("text").distinct(), index)
    found = seen.join(by_text, "text", "left").select("sab", "code", "text", F.coalesce("native", "cui").alias("cui"), F.when(F.col("native").isNotNull(), "native_id_mapping").otherwise(F.col("method")).alias("method"))
    return mentions.join(found, ["sab", "code", "text"], "left").withColumn("method", F.coalesce("method", F.lit("no_mapping")))


#: Of a pair's long score the bits of its difference of lengths, and what the score is multiplied by to make room for a name's number.
_LENGTH_BITS, _NUMBERS = 32, 10**18


def _common_first(mine: Column, other: Column, size: Column, other_size: Column) -> Column:
    """A number that is larger the more words are common, then the closer the lengths are; -1 if a text is null (its size is -1)."""
    key = F.shiftleft(F.size(F.array_intersect(mine, other)).cast("long"), _LENGTH_BITS) + (F.lit(2**31 - 1).cast("long") - F.abs(size.cast("long") - other_size.cast("long")))
    return F.when((size < 0) | (other_size < 0), F.lit(-1).cast("long")).otherwise(key)


def _shaped(rows: DataFrame, text: str) -> DataFrame:
    """rows with all of a text that scores depend on: its folded form, words and length."""
    words = F.coalesce(F.array_sort(tokens(F.col(text))), F.array().cast("array<string>"))
    return rows.select("*", folded(F.col(text)).alias("same"), words.alias("words"), F.coalesce(F.length(text), F.lit(-1)).alias("size"))


def nearest_classes(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """cui, words, size, key, line_no, str: of each distinct (cui, words, size) the name with the highest key, the first of several.

    Names with the same words and length are one, and the best is a number, so that a concept's pairs are
    aggregated as they are made; none is sorted, written or shuffled.
    """
    names = names.groupBy("cui", F.col("words").alias("w"), F.col("size").alias("z")).agg(F.min(F.struct("line_no", "str")).alias("first"))
    names = names.withColumn("number", F.row_number().over(Window.partitionBy("cui").orderBy("first")).cast("long"))
    pairs = wanted.select("cui", "words", "size").distinct().join(names.select("cui", "w", "z", "number"), "cui")
    value = _common_first(F.col("words"), F.col("w"), F.col("size"), F.col("z")).cast("decimal(19,0)") * F.lit(_NUMBERS).cast("decimal(19,0)") - F.col("number").cast("decimal(19,0)")
    best = pairs.groupBy("cui", "words", "size").agg(F.max(value.cast("decimal(38,0)")).alias("best"))
    best = best.withColumn("number", F.pmod(-F.col("best"), F.lit(_NUMBERS).cast("decimal(38,0)")).cast("long"))
    found = best.join(names.select("cui", "w", "z", "number", "first"), ["cui", "number"])
    return found.select("cui", "words", "size", _common_first(F.col("words"), F.col("w"), F.col("size"), F.col("z")).alias("key"), "first.*")


def closest_synonym(mentions: DataFrame, atoms: DataFrame, preferred_only: bool = False) -> DataFrame:
    """id, name: of a concept's names the one nearest to a mention's text. mentions: id, cui, text.

    A name that is the same but for case counts first; then the most common words, the nearest length, the first line.
    """
    names = preferred_names(atoms).select("cui", F.col("name").alias("str"), F.lit(0).cast("long").alias("line_no")) if preferred_only else atoms.select("cui", "str", "line_no")
    rows, names = _shaped(mentions.select("id", "cui", "text"), "text").drop("text"), _shaped(names, "str")
    of_form = names.groupBy("cui", "same", F.col("size").alias("z")).agg(F.min(F.struct("line_no", "str")).alias("first"))
    key = _common_first(F.col("words"), F.col("words"), F.col("size"), F.col("z"))
    score = F.struct(F.lit(0).alias("other"), (-F.col("key")).alias("key"), F.col("first.line_no").alias("line_no"), F.col("first.str").alias("str"))
    equal = rows.select("cui", "same", "words", "size").distinct().join(of_form, ["cui", "same"]).withColumn("key", key).groupBy("cui", "same", "size").agg(F.min(score).alias("equal"))
    rows = rows.join(equal, ["cui", "same", "size"], "left")
    score = F.struct(F.lit(1).alias("other"), (-F.col("key")).alias("key"), "line_no", "str")
    near = nearest_classes(rows.where("equal is null"), names).select("cui", "words", "size", score.alias("near"))
    rows = rows.join(near, ["cui", "words", "size"], "left").select("id", F.coalesce("equal", "near").alias("score")).where("score is not null")
    return rows.groupBy("id").agg(F.min("score")["str"].alias("name"))


def alias_lookup(codes_: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of each concept, its codes under the first alias of a vocabulary that it has. aliases: vocab, sab, prio."""
    rows = codes_.join(aliases, "sab")
    best = Window.partitionBy("cui", "vocab").orderBy("prio")
    return rows.withColumn("r", F.rank().over(best)).where("r = 1").drop("r")


def merged(crosswalks: list[DataFrame]) -> DataFrame:
    """Cross-walks (dataset, cui, sab, code, tty) as one: of equal codes the last dataset's entry, by name."""
    rows = reduce(DataFrame.unionByName, crosswalks)
    return rows.groupBy("cui", "sab", "code").agg(F.max_by("tty", "dataset").alias("tty"), F.count_distinct("dataset").alias("datasets"))
