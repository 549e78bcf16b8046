"""The registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import concepts, datasets, hierarchy, mentions, search, statistics, traversal
from ..operators.service import ConceptService
from ..session import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def count(name: str = "n"):
    return F.count("*").cast("long").alias(name)


# Atoms, mentions and edges made of the star schema.

ATOMS = """atoms AS (SELECT 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, CASE WHEN p_partkey % 7 = 0 THEN 'FRE' ELSE 'ENG' END AS lat,
  CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS ispref, p_brand AS sab, CASE p_type WHEN 'ECONOMY' THEN 'PT' WHEN 'STANDARD' THEN 'PN' ELSE p_type END AS tty,
  CAST(p_partkey AS VARCHAR) AS code, p_name || ' ' || lower(p_type) AS str, p_partkey AS line_no FROM part)"""
MENTIONS = """mentions AS (SELECT p_brand AS sab, CASE l_linenumber % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(p_partkey + 900000 AS VARCHAR) ELSE '' END AS code,
  CASE l_linenumber % 4 WHEN 0 THEN upper(p_name || ' ' || p_type) WHEN 1 THEN p_name WHEN 2 THEN 'zq ' || p_name ELSE '' END AS text,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 500).cast("string"), 7, "0")).alias("cui"),
        F.when(F.col("p_partkey") % 7 == 0, "FRE").otherwise("ENG").alias("lat"),
        F.when(F.col("p_size") % 2 == 0, "Y").otherwise("N").alias("ispref"),
        F.col("p_brand").alias("sab"),
        F.when(F.col("p_type") == "ECONOMY", "PT").when(F.col("p_type") == "STANDARD", "PN").otherwise(F.col("p_type")).alias("tty"),
        F.col("p_partkey").cast("string").alias("code"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("str"),
        F.col("p_partkey").alias("line_no"),
    )


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_linenumber")
    return rows.select(
        F.col("p_brand").alias("sab"),
        F.when(k % 3 == 0, F.col("p_partkey").cast("string")).when(k % 3 == 1, (F.col("p_partkey") + 900000).cast("string")).otherwise("").alias("code"),
        F.when(k % 4 == 0, F.upper(F.concat("p_name", F.lit(" "), "p_type"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat(F.lit("zq "), "p_name")).otherwise("").alias("text"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


# Linking.

_NORM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 3))"
# Concepts of texts, from a table wanted(text): the folded English index, preferred names, containment.
BY_TEXT = f"""ordered AS (SELECT lower(trim(str)) AS name, list({{'line_no': line_no, 'cui': cui, 'y': ispref = 'Y', 'p': tty IN ('PT', 'PN', 'PF')}} ORDER BY line_no) AS a FROM atoms WHERE lat = 'ENG' GROUP BY 1),
 english AS (SELECT name, list_reduce(a, lambda s, x: CASE WHEN (NOT s.y AND x.y) OR (NOT s.p AND x.p) THEN x ELSE s END).cui AS cui FROM ordered),
 called AS (SELECT cui, min(line_no) AS line_no, coalesce(arg_max(str, line_no) FILTER (WHERE lat = 'ENG' AND str <> ''), arg_min(str, line_no)) AS name FROM atoms GROUP BY cui),
 preferred AS (SELECT lower(name) AS name, arg_min(cui, line_no) AS cui FROM called GROUP BY 1),
 exact AS (SELECT w.text, coalesce(e.cui, p.cui) AS cui FROM wanted w LEFT JOIN english e ON lower(trim(w.text)) = e.name LEFT JOIN preferred p ON lower(trim(w.text)) = p.name WHERE trim(w.text) <> ''),
 normed AS (SELECT n, arg_min(cui, line_no) AS cui, arg_min(str, line_no) AS str, min(line_no) AS line_no FROM (SELECT *, {_NORM.format('str')} AS n FROM atoms WHERE lat = 'ENG') WHERE n <> '' GROUP BY n),
 letters AS (SELECT DISTINCT left(n, 1) AS k FROM normed),
 loose AS (SELECT x.text, x.t, l.k FROM (SELECT text, {_NORM.format('text')} AS t FROM exact WHERE cui IS NULL) x LEFT JOIN letters l ON left(x.t, 1) = l.k WHERE x.t <> ''),
 pairs AS (SELECT x.text, x.t, x.k, m.* FROM loose x JOIN normed m ON x.k = left(m.n, 1) AND (contains(m.n, x.t) OR contains(x.t, m.n))
   UNION ALL SELECT x.text, x.t, x.k, m.* FROM (SELECT * FROM loose WHERE k IS NULL) x JOIN normed m ON contains(m.n, x.t) OR contains(x.t, m.n)),
 near AS (SELECT text, cui FROM (SELECT text, cui, row_number() OVER (PARTITION BY text ORDER BY len(list_intersect({_TOKENS.format('text')}, {_TOKENS.format('str')})) DESC, abs(length(n) - length(t)),
   CASE WHEN k IS NULL OR length(t) < 2 OR left(n, 2) = left(t, 2) THEN 0 ELSE 1 END, line_no) AS r FROM pairs) WHERE r = 1),
 bytext AS (SELECT text, cui, 'exact_match' AS method FROM exact WHERE cui IS NOT NULL UNION ALL SELECT text, cui, 'semantic_containment' FROM near)"""
CASCADE = f"""{ATOMS}, {MENTIONS}, keys AS (SELECT DISTINCT sab, code, text, split_part(trim(code), '.', 1) AS bare FROM mentions),
 native AS (SELECT k.sab, k.code, k.text, i.cui FROM keys k JOIN (SELECT sab, code, arg_min(cui, line_no) AS cui FROM atoms GROUP BY 1, 2) i ON k.sab = i.sab AND k.bare = i.code WHERE length(k.bare) >= 3),
 left1 AS (SELECT k.* FROM keys k LEFT JOIN native n ON k.sab = n.sab AND k.code = n.code AND k.text = n.text WHERE n.cui IS NULL),
 wanted AS (SELECT DISTINCT text FROM left1), {BY_TEXT},
 found AS (SELECT *, 'native_id_mapping' AS method FROM native UNION ALL SELECT k.sab, k.code, k.text, b.cui, b.method FROM left1 k JOIN bytext b ON k.text = b.text),
 linked AS (SELECT m.*, f.cui, coalesce(f.method, 'no_mapping') AS method FROM mentions m LEFT JOIN found f ON m.sab = f.sab AND m.code = f.code AND m.text = f.text)"""


@query(f"WITH {CASCADE} SELECT method, coalesce(cui, '') AS cui, count(*) AS n FROM linked GROUP BY 1, 2")
def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = concepts.cascade(part_mentions(spark, sf_dir), atoms(spark, sf_dir))
    return linked.groupBy("method", F.coalesce("cui", F.lit("")).alias("cui")).agg(count())


# Each corpus's own order of tries, over mentions whose columns hold codes of several sources and spellings.

_VOCABULARY = """src AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'SNOMEDCT_US' WHEN 1 THEN 'SCTSPA' WHEN 2 THEN 'MDR' WHEN 3 THEN 'MSH' WHEN 4 THEN 'SNOMEDCT' ELSE 'OMIM' END AS vocab FROM part),
  atoms AS (SELECT 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, CASE WHEN p_partkey % 7 = 0 THEN 'FRE' ELSE 'ENG' END AS lat, CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS ispref, vocab AS sab,
    CASE p_type WHEN 'ECONOMY' THEN 'PT' ELSE p_type END AS tty, CASE WHEN vocab = 'MSH' THEN 'D' ELSE '' END || (p_partkey + 1000) AS code, p_name || ' ' || lower(p_type) AS str, p_partkey AS line_no FROM src),
  types AS (SELECT DISTINCT cui, 'T' || substr(cui, 6) AS tui FROM atoms WHERE right(cui, 1) <> '3')"""
_DATASET = """dm AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN upper(p_name || ' ' || p_type) WHEN 1 THEN p_name WHEN 2 THEN 'zq ' || p_name ELSE '' END AS text,
  CASE (l_linenumber + l_suppkey) % 5 WHEN 0 THEN CAST(l_partkey + 1000 AS VARCHAR) WHEN 1 THEN '00' || (l_partkey + 1000) || '.0' WHEN 2 THEN 'C' || lpad(CAST(l_partkey % 700 AS VARCHAR), 7, '0') WHEN 3 THEN 'CONCEPT-LESS' ELSE '-1' END AS one,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(l_suppkey + 1000 AS VARCHAR) WHEN 1 THEN 'D' || (l_partkey + 1000) ELSE '' END AS two, vocab FROM lineitem JOIN src ON l_partkey = p_partkey)"""
#: Of each corpus: its query's tries as (column, source) and the columns that make its combinations.
_TRIES_SQL = {
    "cdr": [("one", "vocab")],
    "ncbi": [("one", "'CONCEPT'"), ("two", "vocab")],
    "medmentions": [("one", "'CONCEPT'")],
    "cadec": [("one", "'SNOMEDCT_US'"), ("one", "'SCTSPA'"), ("one", "'SNOMEDCT'"), ("one", "'SNOMEDCT_CORE'"), ("two", "'MDR'")],
    "cometa": [(c, x) for c in ("one", "two") for x in ("'SNOMEDCT_US'", "'SCTSPA'", "'SNOMEDCT'", "'SNOMEDCT_CORE'", "'CONCEPT'")],
    "adr": [("one", "'MDR'")],
    "mantra": [("one", "'CONCEPT'")],
    "mimic": [("one", "'SNOMEDCT_US'")],
    "share": [("one", "'CONCEPT'")],
}
_COLUMNS = {
    "cdr": {"native_id": "one", "native_ontology_name": "vocab"}, "ncbi": {"concept_id": "one", "native_id": "two", "native_ontology_name": "vocab"}, "medmentions": {"cui": "one"}, "cadec": {"snomed_id": "one", "meddra_id": "two"},
    "cometa": {"specific_id": "one", "general_id": "two"}, "adr": {"native_id": "one"}, "mantra": {"native_id": "one"}, "mimic": {"native_id": "one"}, "share": {"native_id": "one"},
}


def _dataset_sql(tries: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT one, two, vocab, text, {10 * k} AS prio, {source} AS sab, {column} AS raw FROM combos" for k, (column, source) in enumerate(tries))
    return f"""WITH {_VOCABULARY}, {_DATASET}, combos AS (SELECT DISTINCT one, two, vocab, text FROM dm), raws AS ({rows}),
  bare AS (SELECT *, CASE WHEN sab = 'CONCEPT' THEN CASE WHEN trim(raw) LIKE 'C%' AND length(trim(raw)) >= 7 THEN trim(raw) END WHEN length(split_part(trim(raw), '.', 1)) >= 3 AND lower(raw) <> 'concept-less' THEN split_part(trim(raw), '.', 1) END AS code FROM raws),
  steps AS (SELECT one, two, vocab, text, prio, sab, code FROM bare WHERE code IS NOT NULL UNION ALL
    SELECT one, two, vocab, text, prio + 1, sab, CASE sab WHEN 'MSH' THEN CASE WHEN code LIKE 'D%' THEN substr(code, 2) ELSE 'D' || code END WHEN 'SNOMEDCT_US' THEN ltrim(code, '0') ELSE CAST(TRY_CAST(code AS BIGINT) AS VARCHAR) END FROM bare WHERE code IS NOT NULL AND sab IN ('MSH', 'SNOMEDCT_US', 'MDR')),
  ix AS (SELECT sab, code, arg_min(cui, line_no) AS cui FROM atoms GROUP BY 1, 2 UNION ALL SELECT 'CONCEPT', cui, cui FROM types),
  native AS (SELECT one, two, vocab, text, arg_min(ix.cui, prio) AS cui FROM steps JOIN ix ON steps.sab = ix.sab AND steps.code = ix.code GROUP BY ALL),
  rest AS (SELECT c.* FROM combos c LEFT JOIN native n USING (one, two, vocab, text) WHERE n.cui IS NULL), wanted AS (SELECT DISTINCT text FROM rest WHERE text <> ''), {BY_TEXT},
  found AS (SELECT one, two, vocab, text, cui, 'native_id_mapping' AS method FROM native UNION ALL SELECT r.one, r.two, r.vocab, r.text, b.cui, b.method FROM rest r JOIN bytext b ON r.text = b.text)
  SELECT coalesce(f.method, 'no_mapping') AS method, coalesce(f.cui, '') AS cui, count(*) AS n FROM dm LEFT JOIN found f USING (one, two, vocab, text) GROUP BY 1, 2"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("SNOMEDCT_US", "SCTSPA", "MDR", "MSH", "SNOMEDCT", "OMIM")])
    src = p.withColumn("vocab", F.element_at(names, (k % 6 + 1).cast("int")))
    made = src.select(
        F.concat(F.lit("C"), F.lpad((k % 500).cast("string"), 7, "0")).alias("cui"), F.when(k % 7 == 0, "FRE").otherwise("ENG").alias("lat"), F.when(F.col("p_size") % 2 == 0, "Y").otherwise("N").alias("ispref"), F.col("vocab").alias("sab"),
        F.when(F.col("p_type") == "ECONOMY", "PT").otherwise(F.col("p_type")).alias("tty"), F.concat(F.when(F.col("vocab") == "MSH", "D").otherwise(""), (k + 1000).cast("string")).alias("code"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("str"), k.alias("line_no"),
    )
    types = made.select("cui", F.concat(F.lit("T"), F.substring("cui", 6, 9)).alias("tui")).distinct().where("right(cui, 1) <> '3'").withColumn("pos", F.lit(0))
    return src, made, types


def _dataset_mentions(spark: SparkSession, sf_dir: str, src: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    rows, key = (table(spark, sf_dir, "lineitem") if lines is None else lines).join(src, F.col("l_partkey") == F.col("p_partkey")), (F.col("l_partkey") + 1000).cast("string")
    k, v = F.col("l_linenumber"), (F.col("l_linenumber") + F.col("l_suppkey")) % 5
    return rows.select(
        F.when(k % 4 == 0, F.upper(F.concat("p_name", F.lit(" "), "p_type"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat(F.lit("zq "), "p_name")).otherwise("").alias("text"),
        F.when(v == 0, key).when(v == 1, F.concat(F.lit("00"), key, F.lit(".0"))).when(v == 2, F.concat(F.lit("C"), F.lpad((F.col("l_partkey") % 700).cast("string"), 7, "0"))).when(v == 3, "CONCEPT-LESS").otherwise("-1").alias("one"),
        F.when(k % 3 == 0, (F.col("l_suppkey") + 1000).cast("string")).when(k % 3 == 1, F.concat(F.lit("D"), key)).otherwise("").alias("two"), "vocab", *(["g"] if "g" in rows.columns else []),
    )


def _link_dataset(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src, made, types = _vocabulary(spark, sf_dir)
        rows = _dataset_mentions(spark, sf_dir, src)
        rows = rows.select("text", *[F.col(c).alias(as_) for as_, c in _COLUMNS[name].items()])
        if datasets.SPECS[name].candidates:
            rows = rows.withColumn("candidates", F.array().cast("array<struct<sab:string,code:string>>"))
        if datasets.SPECS[name].retype:
            rows = rows.withColumn("semantic_type", F.lit(""))
        out = datasets.link(rows, made, types, datasets.SPECS[name])
        return out.groupBy("method", F.col("linked").alias("cui")).agg(count())

    run.__name__ = f"link_{name}"
    return run


for _name, _tries in _TRIES_SQL.items():
    query(_dataset_sql(_tries))(_link_dataset(_name))


def _candidates_sql() -> str:
    """As for ncbi; every other mention (g) has candidates of two sources, which take the place of its own id."""
    sql = _dataset_sql([("one", "'CONCEPT'"), ("two", "vocab"), ("two", "'MDR'"), ("one", "vocab")]).replace("one, two, vocab, text", "one, two, vocab, text, g").replace("vocab FROM lineitem JOIN src", "vocab, l_linenumber % 2 = 0 AS g FROM lineitem JOIN src")
    for prio, held in ((10, "NOT g"), (20, "g"), (30, "g")):
        head, tail = sql.split(f", {prio} AS prio", 1)
        sql = head + f", {prio} AS prio" + tail.replace("FROM combos", f"FROM combos WHERE {held}", 1)
    return sql.replace("r.one, r.two, r.vocab, r.text", "r.one, r.two, r.vocab, r.text, r.g")


@query(_candidates_sql())
def link_ncbi_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of mixed sources, in order, before the text."""
    src, made, types = _vocabulary(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    rows = _dataset_mentions(spark, sf_dir, src, lines.withColumn("g", F.col("l_linenumber") % 2 == 0))
    pair = lambda sab, code: F.struct(sab.alias("sab"), F.col(code).alias("code"))
    given = F.when(F.col("g"), F.array(pair(F.lit("MDR"), "two"), pair(F.col("vocab"), "one"))).otherwise(F.array().cast("array<struct<sab:string,code:string>>"))
    rows = rows.select("text", F.col("one").alias("concept_id"), F.col("two").alias("native_id"), F.col("vocab").alias("native_ontology_name"), given.alias("candidates"))
    out = datasets.link(rows, made, types, datasets.SPECS["ncbi"])
    return out.groupBy("method", F.col("linked").alias("cui")).agg(count())


_RETYPED = _dataset_sql(_TRIES_SQL["medmentions"])


@query(_RETYPED[: _RETYPED.rindex("SELECT")] + "SELECT coalesce(f.method, 'no_mapping') AS method, coalesce(y.tui, 'T000') AS semantic_type, count(*) AS n FROM dm LEFT JOIN found f USING (one, two, vocab, text) LEFT JOIN types y ON y.cui = f.cui GROUP BY 1, 2")
def link_medmentions_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked concept's type takes the place of the corpus's, where it has one."""
    src, made, types = _vocabulary(spark, sf_dir)
    rows = _dataset_mentions(spark, sf_dir, src).select("text", F.col("one").alias("cui"), F.lit("T000").alias("semantic_type"))
    return datasets.link(rows, made, types, datasets.SPECS["medmentions"]).groupBy("method", "semantic_type").agg(count())


@query("""WITH k AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'MSH' WHEN 1 THEN 'SNOMEDCT_US' ELSE 'MDR' END AS sab,
  CASE p_partkey % 3 WHEN 0 THEN 'D' || CAST(p_partkey AS VARCHAR) ELSE '00' || CAST(p_partkey AS VARCHAR) END AS code FROM part),
  i AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'MSH' WHEN 1 THEN 'SNOMEDCT_US' ELSE 'MDR' END AS sab, CAST(p_partkey AS VARCHAR) AS code, p_name AS cui FROM part WHERE p_partkey % 5 <> 0),
  t AS (SELECT id, sab, code, 0 AS prio FROM k UNION ALL SELECT id, sab, CASE sab WHEN 'MSH' THEN substr(code, 2) WHEN 'SNOMEDCT_US' THEN ltrim(code, '0') ELSE CAST(CAST(code AS BIGINT) AS VARCHAR) END, 1 FROM k)
  SELECT t.id, arg_min(i.cui, prio) AS cui FROM t JOIN i ON t.sab = i.sab AND t.code = i.code GROUP BY t.id""")
def link_retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    sab = F.when(F.col("p_partkey") % 3 == 0, "MSH").when(F.col("p_partkey") % 3 == 1, "SNOMEDCT_US").otherwise("MDR").alias("sab")
    keys = p.select(F.col("p_partkey").alias("id"), sab, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("D"), key)).otherwise(F.concat(F.lit("00"), key)).alias("code"))
    index = p.where("p_partkey % 5 <> 0").select(sab, key.alias("code"), F.col("p_name").alias("cui"))
    return concepts.link_codes(keys, index)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS prio, 'part' AS sab, CAST(l_partkey * 3 AS VARCHAR) AS code FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, 'supplier', CAST(l_suppkey * 2 AS VARCHAR) FROM lineitem),
  i AS (SELECT 'part' AS sab, CAST(p_partkey AS VARCHAR) AS code, p_name AS cui FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier),
  f AS (SELECT l_partkey, l_suppkey, arg_min(cui, prio) AS cui FROM t JOIN i ON t.sab = i.sab AND t.code = i.code GROUP BY l_partkey, l_suppkey)
  SELECT cui, count(*) AS n FROM f GROUP BY cui""")
def link_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().withColumn("id", F.struct("l_partkey", "l_suppkey"))
    tries = F.array(
        F.struct(F.lit(0).alias("prio"), F.lit("part").alias("sab"), (F.col("l_partkey") * 3).cast("string").alias("code")),
        F.struct(F.lit(1).alias("prio"), F.lit("supplier").alias("sab"), (F.col("l_suppkey") * 2).cast("string").alias("code")),
    )
    index = table(spark, sf_dir, "part").select(F.lit("part").alias("sab"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("cui"))
    index = index.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("sab"), F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("cui")))
    return concepts.link_codes(keys, index, tries).groupBy("cui").agg(count())


@query("""WITH c AS (SELECT o_orderkey, 'C' || lpad(CAST(o_custkey * 2 AS VARCHAR), 7, '0') AS cui FROM orders), k AS (SELECT DISTINCT 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS cui FROM customer)
  SELECT cui, count(*) AS n FROM c WHERE regexp_matches(cui, '^C[0-9]{7}$') AND cui IN (SELECT cui FROM k) GROUP BY cui""")
def validate_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cui = lambda c: F.concat(F.lit("C"), F.lpad(c.cast("string"), 7, "0")).alias("cui")
    used = table(spark, sf_dir, "orders").select(cui(F.col("o_custkey") * 2))
    return concepts.valid_concepts(used, table(spark, sf_dir, "customer").select(cui(F.col("c_custkey")))).groupBy("cui").agg(count())


_COMPOSITE = "CASE l_linenumber % 4 WHEN 0 THEN 'D' || l_partkey || '|' || 'd' || l_suppkey WHEN 1 THEN 'OMIM:' || l_partkey || '|' || l_suppkey WHEN 2 THEN 'D' || l_partkey || '+' || l_suppkey ELSE '-' END"
_CLASS = "CASE WHEN t = '' OR t = '-' THEN NULL WHEN t LIKE 'OMIM:%' THEN 'OMIM ' || substr(t, 6) WHEN regexp_matches(t, '^[Dd][0-9]+$') THEN 'MSH ' || upper(t) WHEN regexp_matches(t, '^[0-9]+$') THEN 'OMIM ' || t ELSE 'MSH ' || t END"


def _composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, k = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    concept = F.when(k % 4 == 0, F.concat(F.lit("D"), p, F.lit("|d"), s)).when(k % 4 == 1, F.concat(F.lit("OMIM:"), p, F.lit("|"), s)).when(k % 4 == 2, F.concat(F.lit("D"), p, F.lit("+"), s)).otherwise("-")
    return table(spark, sf_dir, "lineitem").select(concept.alias("concept"))


@query(f"""WITH c AS (SELECT concept, count(*) AS m FROM (SELECT {_COMPOSITE} AS concept FROM lineitem) GROUP BY concept),
  f AS (SELECT concept, m, list_filter(list_transform(string_split_regex(concept, '[|+]'), lambda t: {_CLASS}), lambda x: x IS NOT NULL) AS found FROM c),
  g AS (SELECT concept, m, CASE WHEN NOT contains(concept, '+') AND len(found) = len(string_split(concept, '|')) AND len(list_distinct(list_transform(found, lambda x: string_split(x, ' ')[1]))) = 1 THEN found ELSE [array_to_string(found, ', ')] END AS parts FROM f),
  h AS (SELECT concept, m, unnest(parts) AS candidates FROM g)
  SELECT candidates, CAST(sum(m) AS BIGINT) AS n FROM h GROUP BY candidates""")
def candidate_split_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions.split_policy(_composites(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("m")))
    shown = F.array_join(F.transform("candidates", lambda x: F.concat(x["sab"], F.lit(" "), x["code"])), ", ")
    return rows.groupBy(shown.alias("candidates")).agg(F.sum("m").cast("long").alias("n"))


@query(f"""WITH c AS (SELECT concept, count(*) AS m FROM (SELECT {_COMPOSITE} AS concept FROM lineitem) GROUP BY concept),
  i AS (SELECT concept, m, list_filter(string_split(concept, '|'), lambda x: trim(x) <> '' AND trim(x) <> '-') AS ids FROM c)
  SELECT native_id, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, unnest(CASE WHEN len(ids) > 0 THEN ids ELSE [concept] END) AS native_id FROM i) GROUP BY native_id""")
def explode_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions.explode_ids(_composites(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("m")))
    return rows.groupBy("native_id").agg(F.sum("m").cast("long").alias("n"))


# Indexes.


@query(f"""WITH {ATOMS}, e AS (SELECT lower(trim(str)) AS name, list({{'line_no': line_no, 'cui': cui, 'y': ispref = 'Y', 'p': tty IN ('PT', 'PN', 'PF')}} ORDER BY line_no) AS a FROM atoms WHERE lat = 'ENG' GROUP BY 1)
  SELECT name, list_reduce(a, lambda s, x: CASE WHEN (NOT s.y AND x.y) OR (NOT s.p AND x.p) THEN x ELSE s END).cui AS cui FROM e""")
def name_index_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.name_index(atoms(spark, sf_dir))


@query(f"WITH {ATOMS} SELECT cui, coalesce(arg_max(str, line_no) FILTER (WHERE lat = 'ENG' AND str <> ''), arg_min(str, line_no)) AS name FROM atoms GROUP BY cui")
def preferred_name_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.preferred_names(atoms(spark, sf_dir))


@query(f"WITH {ATOMS} SELECT sab, tty AS code, arg_min(cui, line_no) AS cui FROM atoms GROUP BY sab, tty")
def code_index_firstwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.code_index(atoms(spark, sf_dir).withColumn("code", F.col("tty")))


_CROSSWALK = """x AS (SELECT cui, sab, string_agg(tty, '|' ORDER BY first_at) AS tty, arg_max(term, last_at) AS term FROM
  (SELECT cui, sab, tty, min(line_no) AS first_at, max(line_no) AS last_at, arg_max(str, line_no) AS term FROM atoms GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(f"WITH {ATOMS}, {_CROSSWALK} SELECT cui, sab, tty, term FROM x")
def tty_set_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.term_types(atoms(spark, sf_dir), ("cui", "sab"))


@query(f"""WITH {ATOMS}, {_CROSSWALK}, c AS (SELECT sab, t AS tty, count(*) AS n FROM (SELECT sab, unnest(string_split(tty, '|')) AS t FROM x) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY sab ORDER BY n DESC, tty) AS rank FROM c) SELECT sab, tty, n, rank FROM r WHERE rank <= 5""")
def tty_stats_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.top_term_types(concepts.term_types(atoms(spark, sf_dir), ("cui", "sab"))).select("sab", "tty", "n", F.col("rank").cast("long").alias("rank"))


def _synonyms(preferred_only: bool) -> str:
    names = "SELECT cui, coalesce(arg_max(str, line_no) FILTER (WHERE lat = 'ENG' AND str <> ''), arg_min(str, line_no)) AS str, 0 AS line_no FROM atoms GROUP BY cui" if preferred_only else "SELECT cui, str, line_no FROM atoms"
    return f"""WITH {ATOMS}, names AS ({names}), m AS (SELECT p_partkey AS id, 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name || ' ' || p_type) ELSE p_name END AS text FROM part),
  r AS (SELECT m.id, n.str, row_number() OVER (PARTITION BY m.id ORDER BY CASE WHEN lower(trim(m.text)) = lower(trim(n.str)) THEN 0 ELSE 1 END, len(list_intersect({_TOKENS.format('m.text')}, {_TOKENS.format('n.str')})) DESC, abs(length(n.str) - length(m.text)), n.line_no, n.str) AS r FROM m JOIN names n ON m.cui = n.cui)
  SELECT id, str AS name FROM r WHERE r = 1"""


def _synonym_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat("p_name", F.lit(" "), "p_type"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 500).cast("string"), 7, "0")).alias("cui"), shown.alias("text"))


@query(_synonyms(False))
def closest_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.closest_synonym(_synonym_mentions(spark, sf_dir), atoms(spark, sf_dir))


@query(_synonyms(True))
def closest_synonym_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.closest_synonym(_synonym_mentions(spark, sf_dir), atoms(spark, sf_dir), preferred_only=True)


@query("WITH t AS (SELECT 'C' || lpad(CAST(p_partkey % 500 AS VARCHAR), 7, '0') AS cui, p_type AS tui, p_partkey AS pos FROM part) SELECT cui, arg_min(tui, pos) AS tui FROM t GROUP BY cui")
def semantic_type_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.first_types(table(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 500).cast("string"), 7, "0")).alias("cui"), F.col("p_type").alias("tui"), F.col("p_partkey").alias("pos")))


# Documents and mentions.


@query("SELECT l_orderkey AS doc_id, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS mentions FROM lineitem GROUP BY 1")
def group_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey")
    docs = mentions.to_documents(rows, ["doc_id"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return docs.select("doc_id", F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["l_linenumber"].cast("string"), m["l_partkey"].cast("string"), m["l_suppkey"].cast("string"))), " ").alias("mentions"))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS start, max(l_partkey) AS first_id FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
  b AS (SELECT l_orderkey AS doc_id, l_linenumber AS start, max(l_partkey) AS second_id FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(coalesce(a.start, b.start) AS BIGINT) AS start, first_id, second_id, coalesce(first_id, second_id) AS native_id FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.start = b.start""")
def span_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("start"), F.col("l_partkey").alias("native_id"), F.col("l_partkey").alias("pos"), "l_returnflag", "l_linestatus")
    return mentions.merge_spans(rows.where("l_returnflag <> 'R'"), rows.where("l_linestatus = 'O'"), ("doc_id", "start"))


@query("SELECT d.doc_id, l.quality, substr(d.text, CAST(d.doc_id % 50 AS INTEGER) + 1, 20) AS mention FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def note_annotation_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), "quality", (F.col("doc_id") % 50).cast("int").alias("start")).withColumn("end", F.col("start") + 20)
    return mentions.with_notes(marks, notes).select(F.col("note_id").alias("doc_id"), "quality", "mention")


@query("""WITH m AS (SELECT doc_id, 'train' AS split, 0 AS prio FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'dev', 1 FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'test', 2 FROM labels WHERE toxic = 1),
  f AS (SELECT doc_id, arg_min(split, prio) AS split FROM m GROUP BY doc_id) SELECT d.doc_id, coalesce(f.split, 'unknown') AS split FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    member = lambda cond, name, prio: marks.where(cond).select("doc_id", F.lit(name).alias("split"), F.lit(prio).alias("prio"))
    members = member("quality = 1", "train", 0).unionByName(member("doc_id % 3 = 0", "dev", 1)).unionByName(member("toxic = 1", "test", 2))
    return mentions.split_of(table(spark, sf_dir, "documents").select("doc_id"), members)


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions.section_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.col("offset").cast("long").alias("start"))


@query("""WITH s AS (SELECT doc_id, text, CAST(doc_id % 40 AS INTEGER) AS a, CAST(doc_id % 40 + doc_id % 7 AS INTEGER) AS b FROM documents)
  SELECT doc_id, a >= 0 AND a < b AND b <= length(text) AS in_range, (a >= 0 AND a < b AND b <= length(text)) AND substr(text, a + 1, b - a) = substr(text, 1, b - a) AS matches FROM s""")
def span_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).cast("int").alias("start"), (F.col("doc_id") % 40 + F.col("doc_id") % 7).cast("int").alias("end"))
    rows = rows.withColumn("mention", F.substring(F.col("text"), F.lit(1), F.col("end") - F.col("start")))
    return mentions.valid_spans(rows, "text").select("doc_id", "in_range", "matches")


# Text.


@query("""WITH s AS (SELECT doc_id, text, substr(text, CAST(floor(length(text) / 2) AS INTEGER), 6) AS term FROM documents)
  SELECT doc_id, CAST(instr(lower(text), lower(term)) - 1 AS BIGINT) AS start FROM s WHERE term <> '' AND contains(lower(text), lower(term))""")
def find_span_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring(F.col("text"), F.expr("cast(floor(length(text) / 2) as int)"), F.lit(6)).alias("term")).where("term <> ''")
    start, _ = text.find_ignoring_case(F.col("text"), F.col("term"))
    return rows.where(F.contains(F.lower("text"), F.lower("term"))).select("doc_id", start.cast("long").alias("start"))


@query("""WITH s AS (SELECT doc_id, text, CAST(doc_id % 60 AS INTEGER) AS a, CAST(doc_id % 60 + 5 AS INTEGER) AS b FROM documents)
  SELECT doc_id, trim(regexp_extract(substr(text, 1, a), '([^.!?]*)$', 1) || regexp_extract(substr(text, a + 1), '^([^.!?]*[.!?]?)', 1), ' \n\t\r') AS sentence FROM s""")
def sentence_of_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("doc_id") % 60).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.sentence_around(F.col("text"), a, a + 5).alias("sentence"))


_NOISE = "replace(replace(replace(text, '. ', ' .  ( '), ', ', ' ,, ____ ) _ x :  - a / b' || chr(10) || ' ' || chr(10) || chr(10) || chr(10)), ' d', ' ' || chr(10) || ' __ d')"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NOISE).alias("text"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, ' +', ' ', 'g'), ' ([.,;:!?)])', '\1', 'g'), '[(] ', '(', 'g'), ' +\n', chr(10), 'g'), '\n+', chr(10), 'g') AS clean FROM conversations""".format(_NOISE))
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("conv_id", "turn", text.clean_label(F.col("text")).alias("clean"))


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace({0}, '___+', '', 'g'), '\b__\b', '', 'g'), '\b_\b', '', 'g') AS t FROM conversations),
  b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g') AS t FROM a),
  c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ' +([.,;:!?)])', '\1', 'g'), '[(] +', '(', 'g'), ' +[)]', ')', 'g'), '([A-Za-z0-9_]) +:', '\1:', 'g') AS t FROM b),
  d AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, ' +- +', ' - ', 'g'), ' +/ +', '/', 'g') AS t FROM c)
  SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, '  +', ' ', 'g'), '\n +', chr(10), 'g'), ' +\n', chr(10), 'g'), ' ' || chr(10)) AS clean FROM d""".format(_NOISE))
def clean_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("conv_id", "turn", text.clean_note(F.col("text")).alias("clean"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n+', chr(10), 'g'), ' +([.,;:!?)])', '\1', 'g'), '[(] +', '(', 'g'), '___+', '___', 'g'), ' ' || chr(10)) AS clean FROM conversations""".format(_NOISE))
def clean_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("conv_id", "turn", text.clean_report(F.col("text")).alias("clean"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1) AS tail FROM pages")
def uri_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.uri_tail(F.col("url")).alias("tail"))


@query("SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(count())


@query("""SELECT l_partkey, l_suppkey, substr(p_name, 1, 2) || substr(p_name, 4, 3) AS joined FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey""")
def multi_part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_partkey", "l_suppkey", text.join_parts(F.col("p_name"), text.offset_parts(F.lit("0,3"), F.lit("2, 3"))).alias("joined"))


@query("""WITH t(id, spans) AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1-5,7-9' WHEN 1 THEN CAST(p_partkey AS VARCHAR) || '-' || CAST(p_partkey + p_size AS VARCHAR) ELSE 'x-9,4-2' END FROM part),
  e AS (SELECT id, unnest(string_split(spans, ',')) AS s FROM t), f AS (SELECT id, TRY_CAST(split_part(s, '-', 1) AS INTEGER) AS a, TRY_CAST(split_part(s, '-', 2) AS INTEGER) AS b FROM e)
  SELECT id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS stop FROM f WHERE a IS NOT NULL AND b > a""")
def explode_span_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    spans = F.when(k % 3 == 0, "1-5,7-9").when(k % 3 == 1, F.concat(k.cast("string"), F.lit("-"), (k + F.col("p_size")).cast("string"))).otherwise("x-9,4-2")
    return mentions.explode_spans(p.select(k.alias("id"), spans.alias("spans"))).select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


# Code formats.

_CODES = """SELECT v.vocab, CASE v.k WHEN 0 THEN CAST(1000000 + p_partkey AS VARCHAR) WHEN 1 THEN 'D' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 2 THEN 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') WHEN 3 THEN CAST(p_partkey AS VARCHAR) || '.' || CAST(p_size AS VARCHAR)
  WHEN 4 THEN CAST(p_partkey AS VARCHAR) || '-1' WHEN 5 THEN 'MTHU' || CAST(p_partkey AS VARCHAR) ELSE 'A' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '.' || CAST(p_size AS VARCHAR) END AS code FROM part CROSS JOIN (SELECT * FROM (VALUES ('SNOMEDCT_US', 0), ('MSH', 1), ('GO', 2), ('ICD9CM', 3), ('LNC', 4), ('LNC', 5), ('ICD10CM', 6), ('HPO', 2), ('LCH_NW', 5)) AS w(vocab, k)) v"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    pad = lambda n: F.lpad(key, n, "0")
    made = {
        ("SNOMEDCT_US", 0): (F.col("p_partkey") + 1000000).cast("string"), ("MSH", 1): F.concat(F.lit("D"), pad(6)), ("GO", 2): F.concat(F.lit("GO:"), pad(7)), ("HPO", 2): F.concat(F.lit("GO:"), pad(7)),
        ("LCH_NW", 5): F.concat(F.lit("MTHU"), key), ("ICD9CM", 3): F.concat(key, F.lit("."), F.col("p_size").cast("string")), ("LNC", 4): F.concat(key, F.lit("-1")), ("LNC", 5): F.concat(F.lit("MTHU"), key),
        ("ICD10CM", 6): F.concat(F.lit("A"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("."), F.col("p_size").cast("string")),
    }
    return table(spark, sf_dir, "part").select(F.explode(F.array(*[F.struct(F.lit(v).alias("vocab"), c.alias("code")) for (v, _), c in made.items()])).alias("x")).select("x.*")


@query(f"""WITH c AS ({_CODES}), x AS (SELECT vocab, code, regexp_matches(code, '^[0-9][0-9]\\.[0-9][0-9]?$') OR regexp_matches(code, '^[0-9]+-[0-9]+\\.99$') OR (regexp_matches(code, '^[0-9][0-9]?$') AND code NOT IN ('30', '50', '52', '53')) AS no_diagnosis FROM c)
  SELECT vocab, code, CASE vocab WHEN 'SNOMEDCT_US' THEN regexp_full_match(code, '[0-9]{{6,18}}') WHEN 'MSH' THEN regexp_full_match(code, '[A-Z][0-9]{{6,9}}') WHEN 'GO' THEN regexp_full_match(code, 'GO:[0-9]{{7}}') WHEN 'HPO' THEN regexp_full_match(code, 'HP:[0-9]{{7}}')
    WHEN 'LNC' THEN regexp_full_match(code, '[0-9][0-9][0-9][0-9]+-[0-9]') OR regexp_full_match(code, 'MTHU[0-9]{{6}}') OR regexp_full_match(code, 'L[PAL][0-9]{{4,}}-[0-9]') OR regexp_full_match(code, 'LG[0-9]{{5}}-[0-9]')
    WHEN 'LCH_NW' THEN length(code) > 3 AND regexp_full_match(code, '[a-zA-Z0-9]+')
    ELSE NOT no_diagnosis AND (regexp_full_match(code, '[A-Z][0-9][0-9]([.][0-9]{{1,4}})?') OR regexp_full_match(code, '[A-Z][0-9][0-9][A-Z]([.][0-9]{{1,3}})?') OR regexp_full_match(code, '[A-Z][0-9][0-9]-[A-Z][0-9][0-9]') OR regexp_full_match(code, '[A-Z][0-9][A-Z]([.][0-9]{{1,3}})?')
      OR regexp_full_match(code, '[0-9]{{2,3}}([.][0-9]{{1,2}})?') OR regexp_full_match(code, 'V[0-9][0-9]([.][0-9]{{1,2}})?') OR regexp_full_match(code, 'E[0-9]{{3,4}}([.][0-9])?') OR regexp_full_match(code, '[0-9]{{3}}-[0-9]{{3}}([.]99)?')) END AS ok, starts_with(code, 'MTHU') AS skipped FROM x""")
def code_format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("vocab", "code", codes.valid(F.col("vocab"), F.col("code")).alias("ok"), codes.loinc_skipped(F.col("code")).alias("skipped"))


@query("""WITH c AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CAST(p_partkey % 100 AS VARCHAR) WHEN 2 THEN CAST(p_partkey AS VARCHAR) || '-' || CAST(p_partkey + 9 AS VARCHAR) || '.99' ELSE CAST(100 + p_size AS VARCHAR) || '.1' END AS code FROM part)
  SELECT code FROM c WHERE NOT (regexp_matches(code, '^[0-9]{2}[.][0-9]{1,2}$') OR regexp_matches(code, '^[0-9]+-[0-9]+[.]99$') OR (regexp_matches(code, '^[0-9]{1,2}$') AND code NOT IN ('30', '50', '52', '53')))""")
def icd_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    code = F.when(k % 4 == 0, size).when(k % 4 == 1, F.concat(F.lpad(size, 2, "0"), F.lit("."), (k % 100).cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("-"), (k + 9).cast("string"), F.lit(".99"))).otherwise(F.concat((F.col("p_size") + 100).cast("string"), F.lit(".1")))
    return table(spark, sf_dir, "part").select(code.alias("code")).distinct().where(~codes.icd_excluded(F.col("code")))


# Search by words.

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim({0})), '[^a-z0-9]+'), lambda x: length(x) >= 3))"
_SIZE = r"length(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}]', '', 'g'))"
_SEARCHED = f"""n AS (SELECT line_no, cui, {_SIZE.format("str")} AS z, {_WORDS.format("str")} AS w FROM names), a AS (SELECT id, {_SIZE.format("text")} AS z, {_WORDS.format("text")} AS w FROM asked),
  b AS (SELECT a.id, a.t, a.z AS az, n.line_no, n.cui, n.z, count(*) AS shared FROM (SELECT id, id AS t, z, unnest(w) AS x FROM a) a JOIN (SELECT line_no, cui, z, unnest(w) AS x FROM n) n ON a.x = n.x GROUP BY ALL),
  best AS (SELECT id, cui, line_no, CAST(shared AS INTEGER) AS shared FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, abs(z - az), line_no) = 1)"""


def _name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as names."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "str"))
    return rows.select(F.concat(F.lit("C"), F.lpad((F.col("doc_id") % 500).cast("string"), 7, "0")).alias("cui"), F.lit("ENG").alias("lat"), "str", (F.col("doc_id") * 100000 + F.col("at")).alias("line_no"))


@query(f"""WITH names AS (SELECT 'C' || lpad(CAST(doc_id % 500 AS VARCHAR), 7, '0') AS cui, unnest(string_split(text, chr(10))) AS str, doc_id * 100000 + unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
  asked AS (SELECT item_id * 1000 + unnest(range(0, len(string_split(text, '.')))) AS id, unnest(string_split(text, '.')) AS text FROM benchmark), {_SEARCHED} SELECT * FROM best""")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the benchmark among the lines of all documents."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("at", "text")).select((F.col("item_id") * 1000 + F.col("at")).alias("id"), "text")
    return search.search_words(asked, search.WordIndex(_name_lines(spark, sf_dir), words=search.words_of(asked)))


@query(f"""WITH {ATOMS}, {MENTIONS}, names AS (SELECT cui, str, line_no FROM atoms WHERE lat = 'ENG'), asked AS (SELECT DISTINCT text AS id, text FROM mentions WHERE text <> ''), {_SEARCHED},
  f AS (SELECT lower(trim(str)) AS name, list({{'cui': cui, 'y': ispref = 'Y', 'p': tty IN ('PT', 'PN', 'PF')}} ORDER BY line_no) AS l FROM atoms WHERE lat = 'ENG' GROUP BY 1),
  x AS (SELECT name, list_reduce(l, lambda s, t: CASE WHEN (NOT s.y AND t.y) OR (NOT s.p AND t.p) THEN t ELSE s END).cui AS cui FROM f)
  SELECT asked.text, coalesce(x.cui, best.cui) AS cui, CASE WHEN x.cui IS NOT NULL THEN 'exact_match' ELSE 'semantic_containment' END AS method FROM asked LEFT JOIN x ON lower(trim(asked.text)) = x.name LEFT JOIN best ON best.id = asked.id WHERE coalesce(x.cui, best.cui) IS NOT NULL""")
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names first, then the search by words."""
    texts = part_mentions(spark, sf_dir).where("text <> ''").select("text").distinct()
    return search.link_by_search(texts, atoms(spark, sf_dir))


_TYPED = "types AS (SELECT DISTINCT cui, 'T' || (CAST(right(cui, 2) AS INTEGER) % 30) AS tui, 0 AS pos FROM atoms WHERE right(cui, 1) <> '3' UNION SELECT cui, 'T9', 1 FROM atoms WHERE right(cui, 1) IN ('1', '3'))"


def _service(spark: SparkSession, sf_dir: str) -> ConceptService:
    made = atoms(spark, sf_dir)
    cuis, last = made.select("cui").distinct(), F.right("cui", F.lit(1))
    first = cuis.where(last != "3").select("cui", F.concat(F.lit("T"), (F.right("cui", F.lit(2)).cast("int") % 30).cast("string")).alias("tui"), F.lit(0).alias("pos"))
    types = first.union(cuis.where(last.isin("1", "3")).select("cui", F.lit("T9"), F.lit(1)))
    return ConceptService.build(made, types, shared_path(spark, "service"))


@query(f"""WITH {ATOMS}, {_TYPED}, asked AS (SELECT DISTINCT 'C' || lpad(CAST(l_partkey % 700 AS VARCHAR), 7, '0') AS cui FROM lineitem), own AS (SELECT * FROM atoms WHERE cui IN (SELECT cui FROM asked)),
  c AS (SELECT cui, string_agg(k, '|' ORDER BY k) AS codes FROM (SELECT DISTINCT cui, sab || ':' || code AS k FROM own) GROUP BY cui), y AS (SELECT cui, string_agg(tui, '|' ORDER BY pos, tui) AS types FROM (SELECT cui, tui, min(pos) AS pos FROM types GROUP BY ALL) GROUP BY cui),
  n AS (SELECT cui, coalesce(arg_max(str, line_no) FILTER (WHERE lat = 'ENG' AND str <> ''), arg_min(str, line_no)) AS name FROM own GROUP BY cui)
  SELECT asked.cui, n.cui IS NOT NULL AS valid, n.name, CASE WHEN n.cui IS NULL THEN '' ELSE coalesce(types, '') END AS types, coalesce(codes, '') AS codes FROM asked LEFT JOIN n USING (cui) LEFT JOIN y USING (cui) LEFT JOIN c USING (cui)""")
def service_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service tells of all concepts that mentions have, valid or not."""
    asked = table(spark, sf_dir, "lineitem").select(F.lpad((F.col("l_partkey") % 700).cast("string"), 7, "0").alias("cui"))
    return _service(spark, sf_dir).records(asked).select("cui", "valid", "name", F.array_join("types", "|").alias("types"), F.array_join("codes", "|").alias("codes"))


# Hierarchies.

EDGES = """e AS (SELECT DISTINCT 'P' || l_partkey AS child, 'S' || l_suppkey AS parent FROM lineitem UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"""
_WALK = """r(code, node, path, depth) AS (SELECT DISTINCT child, child, child, 1 FROM e WHERE child LIKE 'P%' UNION ALL SELECT r.code, e.parent, e.parent || ' > ' || r.path, r.depth + 1 FROM r JOIN e ON e.child = r.node),
  p AS (SELECT code, path, depth FROM r LEFT JOIN e ON e.child = r.node WHERE e.child IS NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    link = lambda df, a, b: df.select(a.alias("child"), b.alias("parent"))
    return (
        link(table(spark, sf_dir, "lineitem"), name("P", "l_partkey"), name("S", "l_suppkey"))
        .union(link(table(spark, sf_dir, "supplier"), name("S", "s_suppkey"), name("N", "s_nationkey")))
        .union(link(table(spark, sf_dir, "nation"), name("N", "n_nationkey"), name("R", "n_regionkey")))
        .distinct()
    )


def _part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return hierarchy.walk_up(edges.where("child like 'P%'").select(F.col("child").alias("code")), edges, guard=False)


def _part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.path_counts(_edges(spark, sf_dir)).where("node like 'P%'").select(F.col("node").alias("code"), "length", "n")


def shown(column: str = "path"):
    return F.array_join(column, " > ").alias("path")


@query(f"WITH RECURSIVE {EDGES}, {_WALK} SELECT code, path FROM p")
def path_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_paths(spark, sf_dir).select("code", shown())


@query(f"""WITH RECURSIVE {EDGES}, {_WALK}, named AS (SELECT 'S' || s_suppkey AS code, s_name AS name FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
  steps AS (SELECT code, path, unnest(string_split(path, ' > ')) AS node, unnest(range(1, depth + 1)) AS nth FROM p)
  SELECT s.code, string_agg(node || '=' || coalesce(name, 'Unknown: ' || node), ' > ' ORDER BY nth) AS path FROM steps s LEFT JOIN named n ON s.node = n.code GROUP BY s.code, s.path""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = lambda name, letter, key, c: table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("code"), F.col(c).alias("name"))
    names = called("supplier", "S", "s_suppkey", "s_name").union(called("nation", "N", "n_nationkey", "n_name")).union(called("region", "R", "r_regionkey", "r_name"))
    rows = hierarchy.with_names(_part_paths(spark, sf_dir), names)
    return rows.select("code", F.array_join(F.transform("path", lambda x: F.concat(x["code"], F.lit("="), x["name"])), " > ").alias("path"))


@query("""WITH t AS (SELECT page_id, chr(CAST(65 + page_id % 9 AS INTEGER)) || CAST(page_id % 90 AS VARCHAR) AS top, page_id % 7 AS mid FROM pages), known AS (SELECT DISTINCT top AS tree, 'U' || top AS ui FROM t WHERE mid < 5 UNION SELECT DISTINCT top || '.' || mid, 'M' || top || mid FROM t),
  roots(k, name) AS (SELECT * FROM (VALUES ('A', 'Anatomy'), ('B', 'Organisms'), ('C', 'Diseases'), ('D', 'Chemicals and Drugs'), ('E', 'Analytical, Diagnostic and Therapeutic Techniques, and Equipment'), ('F', 'Psychiatry and Psychology'), ('G', 'Phenomena and Processes'), ('H', 'Disciplines and Occupations'), ('I', 'Anthropology, Education, Sociology and Social Phenomena')) v(a, b))
  SELECT DISTINCT 'M' || t.top || t.mid AS code, left(t.top, 1) || '=' || roots.name || ' > ' || coalesce(a.ui || '=name of ' || a.ui, t.top || '=Unknown: ' || t.top) || ' > M' || t.top || t.mid || '=name of M' || t.top || t.mid AS path
  FROM t JOIN roots ON left(t.top, 1) = roots.k LEFT JOIN known a ON a.tree = t.top""")
def path_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    top = F.concat(F.chr(65 + k % 9), (k % 90).cast("string"))
    mid = (k % 7).cast("string")
    pages = table(spark, sf_dir, "pages")
    upper = pages.where(k % 7 < 5).select(top.alias("tree"), F.concat(F.lit("U"), top).alias("code"))
    trees = upper.union(pages.select(F.concat(top, F.lit("."), mid), F.concat(F.lit("M"), top, mid))).distinct().withColumn("name", F.concat(F.lit("name of "), "code"))
    rows = hierarchy.descriptor_paths(trees).where("code like 'M%'")
    return rows.select("code", F.array_join(F.transform("path", lambda x: F.concat(x["code"], F.lit("="), x["name"])), " > ").alias("path")).distinct()


@query(f"""WITH RECURSIVE {EDGES}, o AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY parent) AS pos FROM e), w(code, node, path, k) AS (SELECT DISTINCT child, child, child, '' FROM o WHERE child LIKE 'P%' UNION ALL
  SELECT w.code, o.parent, o.parent || ' > ' || w.path, w.k || lpad(CAST(o.pos AS VARCHAR), 4, '0') FROM w JOIN o ON o.child = w.node)
  SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY k) AS INTEGER) AS rank, path FROM w WHERE node LIKE 'R%' QUALIFY rank <= 7""")
def path_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paths of each code by its parents in order, by counts."""
    edges = _edges(spark, sf_dir)
    return traversal.first_paths(edges.where("child like 'P%'").select(F.col("child").alias("code")), edges, 7).select("code", "rank", shown())


# Suppliers in rings of four, of which some have nations too; some nations are missing in the vocabulary.

_RINGS = """l AS (SELECT 'S' || s_suppkey AS child, 'S' || (s_suppkey - s_suppkey % 4 + (s_suppkey + 1) % 4) AS parent FROM supplier UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier WHERE s_suppkey % 8 IN (0, 2)
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation WHERE n_nationkey % 5 <> 0)"""
_RINGED = f"{_RINGS}, m AS (SELECT * FROM l UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem)"
_NAMED = """named AS (SELECT 'P' || p_partkey AS code, p_name AS name FROM part UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'R' || r_regionkey, r_name FROM region)"""


def _rings(spark: SparkSession, sf_dir: str, parts: bool = False) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    link = lambda df, a, b: df.select(a.alias("child"), b.alias("parent"))
    suppliers, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = (
        link(suppliers, name("S", k), name("S", k - k % 4 + (k + 1) % 4))
        .union(link(suppliers.where(F.expr("s_suppkey % 8 in (0, 2)")), name("S", k), name("N", "s_nationkey")))
        .union(link(table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0"), name("N", "n_nationkey"), name("R", "n_regionkey")))
    )
    return (rows.union(link(table(spark, sf_dir, "lineitem"), name("P", "l_partkey"), name("S", "l_suppkey"))) if parts else rows).distinct()


def _ring_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = lambda df, letter, key, c: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("code"), F.col(c).alias("name"))
    of = lambda name: table(spark, sf_dir, name)
    rows = called(of("part"), "P", "p_partkey", "p_name").union(called(of("supplier"), "S", "s_suppkey", "s_name"))
    return rows.union(called(of("nation").where("n_nationkey % 5 <> 0"), "N", "n_nationkey", "n_name")).union(called(of("region"), "R", "r_regionkey", "r_name"))


def _guarded(of: str, start: str = "true", parents: str = "true") -> str:
    """Common table expressions: o, the numbered edges, and r, every way that passes no node twice, with its order."""
    return f"""o AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY parent) AS pos FROM {of} WHERE {parents}), r(code, node, path, seen, k) AS (SELECT DISTINCT child, child, child, '|' || child || '|', '' FROM o WHERE {start}
  UNION ALL SELECT r.code, o.parent, o.parent || ' > ' || r.path, r.seen || o.parent || '|', r.k || lpad(CAST(o.pos AS VARCHAR), 4, '0') FROM r JOIN o ON o.child = r.node WHERE NOT contains(r.seen, '|' || o.parent || '|'))"""


_STUCK = "NOT EXISTS (SELECT 1 FROM o WHERE o.child = r.node AND NOT contains(r.seen, '|' || o.parent || '|'))"


@query(f"WITH RECURSIVE {_RINGS}, {_guarded('l')} SELECT code, path FROM r WHERE node NOT IN (SELECT child FROM o)")
def path_cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _rings(spark, sf_dir)
    return hierarchy.walk_up(edges.select(F.col("child").alias("code")), edges).select("code", shown())


@query(f"WITH RECURSIVE {_RINGS}, {_guarded('l')} SELECT code, path FROM r WHERE {_STUCK}")
def path_root_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _rings(spark, sf_dir)
    return hierarchy.walk_up(edges.select(F.col("child").alias("code")), edges, root_fallback=True).select("code", shown())


def _named_sql(paths: str, label: str) -> str:
    """Paths (code, rank, path) with names, and those of codes U.., which the vocabulary has not."""
    return f"""{paths}, {_NAMED}, a AS (SELECT * FROM p UNION ALL SELECT 'U' || s_suppkey, 1, 'U' || s_suppkey FROM supplier), steps AS (SELECT code, rank, unnest(string_split(path, ' > ')) AS node, generate_subscripts(string_split(path, ' > '), 1) AS nth FROM a)
  SELECT s.code, rank, string_agg(node || '=' || coalesce(name, '{label}' || node), ' > ' ORDER BY nth) AS path FROM steps s LEFT JOIN named ON s.node = named.code GROUP BY s.code, rank"""


def _named_paths(spark: SparkSession, sf_dir: str, letters: str, most: int, label: str) -> DataFrame:
    edges = _rings(spark, sf_dir, parts=True)
    paths = traversal.bounded_paths(edges.where(f"left(child, 1) in ({letters})").select(F.col("child").alias("code")), edges, most)
    unknown = table(spark, sf_dir, "supplier").select(F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("code"))
    paths = hierarchy.with_unknown(unknown, paths.select("code", "path"), edges, "").withColumn("rank", F.lit(1)).where("code like 'U%'").select("code", "rank", "path").unionByName(paths)
    rows = hierarchy.with_names(paths, _ring_names(spark, sf_dir), label, ("rank",))
    return rows.select("code", "rank", F.array_join(F.transform("path", lambda x: F.concat(x["code"], F.lit("="), x["name"])), " > ").alias("path"))


def _capped_sql(most: int, start: str) -> str:
    return f"WITH RECURSIVE {_RINGED}, {_guarded('m', start)}, p AS (SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY k) AS INTEGER) AS rank, path FROM r WHERE node NOT IN (SELECT child FROM o) QUALIFY rank <= {most})"


@query(_named_sql(_capped_sql(5, "child LIKE 'P%'"), "Unknown NCI Concept "))
def path_nci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five paths pass any node; codes that the vocabulary hasn't are a node of their own."""
    return _named_paths(spark, sf_dir, "'P'", 5, "Unknown NCI Concept ")


@query(_named_sql(_capped_sql(2, "true"), "Error: "))
def path_loinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two paths pass any node; nodes that can't be looked up are errors, and roots."""
    return _named_paths(spark, sf_dir, "'P', 'S', 'N'", 2, "Error: ")


@query(f"WITH RECURSIVE {_RINGED}, {_guarded('m', parents="parent IN (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'S' || s_suppkey FROM supplier UNION ALL SELECT 'R' || r_regionkey FROM region)")} SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY k) AS INTEGER) AS rank, path FROM r WHERE {_STUCK} QUALIFY rank <= 3")
def path_lch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three paths pass any node; parents have to be known, and a node without a usable one is a root."""
    edges = _rings(spark, sf_dir, parts=True).join(_ring_names(spark, sf_dir).select(F.col("code").alias("parent")), "parent", "left_semi")
    return traversal.bounded_paths(edges.select(F.col("child").alias("code")), edges, 3, root_fallback=True).select("code", "rank", shown())


@query(f"""WITH RECURSIVE {_RINGED}, o AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY parent) AS pos FROM m), q AS (SELECT DISTINCT child AS code, child AS node, child AS path, 1 AS lvl, CAST(1 AS BIGINT) AS rk, CAST(59 AS BIGINT) AS rest FROM o WHERE child LIKE 'P%' UNION ALL
  SELECT code, node, path, lvl, rk, rest - least(rest, many) FROM (SELECT q.code, o.parent AS node, o.parent || ' > ' || q.path AS path, q.lvl + 1 AS lvl, row_number() OVER (PARTITION BY q.code ORDER BY q.rk, o.pos) AS rk, q.rest, count(*) OVER (PARTITION BY q.code) AS many FROM q JOIN o ON o.child = q.node) WHERE rk <= rest)
  SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY lvl, rk) AS INTEGER) AS rank, path FROM q WHERE node NOT IN (SELECT child FROM o)""")
def path_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty ways of each code are followed, in the order of a queue; nothing else stops the rings."""
    edges = _rings(spark, sf_dir, parts=True)
    return traversal.expanded_paths(edges.where("child like 'P%'").select(F.col("child").alias("code")), edges, 60).select("code", "rank", shown())


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT 'P' || p_partkey AS code FROM part UNION SELECT 'U' || p_partkey FROM part), {_WALK}
  SELECT p.code, p.path FROM p JOIN c ON p.code = c.code UNION ALL SELECT code, 'Unknown: ' || code FROM c WHERE code NOT IN (SELECT child FROM e)""")
def path_unknown_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = lambda letter: table(spark, sf_dir, "part").select(F.concat(F.lit(letter), F.col("p_partkey").cast("string")).alias("code"))
    wanted = coded("P").union(coded("U"))  # the vocabulary has none of the latter
    edges = _edges(spark, sf_dir)
    return hierarchy.with_unknown(wanted, hierarchy.walk_up(wanted, edges, guard=False), edges).select("code", shown())


@query("""SELECT 'O' || o_orderkey AS code, 'R' || n_regionkey || ' > N' || n_nationkey || ' > C' || c_custkey || ' > O' || o_orderkey AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def path_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    link = lambda df, a, b, pos: df.select(a.alias("child"), b.alias("parent"), F.lit(pos).alias("pos"))
    orders = table(spark, sf_dir, "orders")
    edges = link(orders, name("O", "o_orderkey"), name("C", "o_custkey"), 0).union(link(orders, name("O", "o_orderkey"), F.lit("other"), 1))
    edges = edges.union(link(table(spark, sf_dir, "customer"), name("C", "c_custkey"), name("N", "c_nationkey"), 0)).union(link(table(spark, sf_dir, "nation"), name("N", "n_nationkey"), name("R", "n_regionkey"), 0))
    return hierarchy.walk_up(orders.select(name("O", "o_orderkey").alias("code")), hierarchy.single_parent(edges)).select("code", shown())


@query("""WITH t AS (SELECT page_id, 'A' || CAST(page_id % 90 AS VARCHAR) || '.' || CAST(page_id % 7 AS VARCHAR) || '.' || CAST(page_id AS VARCHAR) AS tree FROM pages)
  SELECT page_id, left(tree, 1) || ' > ' || split_part(tree, '.', 1) || ' > ' || split_part(tree, '.', 1) || '.' || split_part(tree, '.', 2) || ' > ' || tree AS down, tree || ' > ' || split_part(tree, '.', 1) || '.' || split_part(tree, '.', 2) || ' > ' || split_part(tree, '.', 1) || ' > ' || left(tree, 1) AS up FROM t""")
def path_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.concat(F.lit("A"), (F.col("page_id") % 90).cast("string"), F.lit("."), (F.col("page_id") % 7).cast("string"), F.lit("."), F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", hierarchy.prefixes(tree).alias("steps"))
    return rows.select("page_id", F.array_join("steps", " > ").alias("down"), F.array_join(F.reverse("steps"), " > ").alias("up"))


@query("""SELECT s_suppkey, array_to_string(list_filter([r_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END, s_name], lambda x: x IS NOT NULL), ' > ') AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def path_wide_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return wide.withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name"))).select("s_suppkey", F.array_join(hierarchy.levels(["r_name", "n_name", "s_name"]), " > ").alias("path"))


@query("SELECT s_suppkey, r_name || ' > ' || n_name || ' > ' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_lineage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineage = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("lineage"))
    return table(spark, sf_dir, "supplier").join(lineage, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array_join(F.concat("lineage", F.array("s_name")), " > ").alias("path"))


@query(f"WITH RECURSIVE {EDGES}, {_WALK} SELECT code, path FROM (SELECT code, path, row_number() OVER (PARTITION BY code ORDER BY path) AS r FROM p WHERE depth <= 4) WHERE r <= 3")
def path_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return traversal.first_paths(edges.where("child like 'P%'").select(F.col("child").alias("code")), edges, 3, 4, root_first=True).select("code", shown())


@query(f"""WITH RECURSIVE {EDGES}, {_WALK}, c AS (SELECT substr(code, length(code)) AS grp, code, count(*) AS n, sum(depth) AS nodes, min(depth) AS lo, max(depth) AS hi FROM p GROUP BY 1, 2)
  SELECT grp, count(*) AS codes, CAST(sum(n) AS BIGINT) AS total_paths, round(avg(n), 9) AS mean_paths, round(median(n), 9) AS median_paths, CAST(min(lo) AS BIGINT) AS min_length, CAST(max(hi) AS BIGINT) AS max_length, round(CAST(sum(nodes) AS DOUBLE) / sum(n), 9) AS mean_length FROM c GROUP BY grp""")
def path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traversal.counted_stats(_part_counts(spark, sf_dir).withColumn("grp", F.right("code", F.lit(1))), ["grp"])
    whole, part = ("total_paths", "min_length", "max_length"), ("mean_paths", "median_paths", "mean_length")
    return out.withColumns({c: F.col(c).cast("long") for c in whole} | {c: F.round(c, 9) for c in part})


@query(f"""WITH RECURSIVE {EDGES}, {_WALK}, n AS (SELECT code, count(*) AS n_paths FROM p GROUP BY code), c AS (SELECT 'C' || lpad(CAST(p_partkey % 50 AS VARCHAR), 7, '0') AS cui, 'P' || p_partkey AS code, p_size FROM part)
  SELECT cui, CASE WHEN NOT regexp_matches(c.code, '^P[0-9]+0$') THEN 'error' WHEN p_size % 5 = 0 THEN 'inactive' WHEN n_paths IS NULL THEN 'not_found' ELSE 'success' END AS status, count(*) AS codes, CAST(sum(coalesce(n_paths, 0)) AS BIGINT) AS paths FROM c LEFT JOIN n ON c.code = n.code GROUP BY 1, 2""")
def cui_code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cui = F.concat(F.lit("C"), F.lpad((F.col("p_partkey") % 50).cast("string"), 7, "0")).alias("cui")
    rows = table(spark, sf_dir, "part").select(cui, F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), "p_size")
    counts = _part_counts(spark, sf_dir).groupBy("code").agg(F.sum("n").cast("long").alias("n_paths"))
    out = hierarchy.code_status(rows, counts, F.col("code").rlike("^P[0-9]+0$"), F.col("p_size") % 5 != 0)
    return out.groupBy("cui", "status").agg(count("codes"), F.sum("n_paths").alias("paths"))


@query(f"""WITH RECURSIVE {EDGES}, {_WALK}, n AS (SELECT code, count(*) AS n FROM p GROUP BY code) SELECT count(*) AS codes, CAST(sum(n) AS BIGINT) AS paths, round(avg(n), 9) AS mean FROM n""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _part_counts(spark, sf_dir).groupBy("code").agg(F.sum("n").cast("long").alias("n"))
    return n.agg(count("codes"), F.sum("n").alias("paths"), F.round(F.avg("n"), 9).alias("mean"))


@query(f"""WITH {ATOMS}, a(vocab, sab, prio) AS (SELECT * FROM (VALUES ('V1', 'Brand#13', 0), ('V1', 'Brand#5', 1), ('V2', 'Brand#5', 0), ('V2', 'Brand#1', 1)) AS v(x, y, z)),
  j AS (SELECT a.vocab, atoms.cui, atoms.code, rank() OVER (PARTITION BY cui, vocab ORDER BY prio) AS r FROM atoms JOIN a ON atoms.sab = a.sab) SELECT vocab, cui, code FROM j WHERE r = 1""")
def vocab_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.sql("SELECT * FROM VALUES ('V1', 'Brand#13', 0), ('V1', 'Brand#5', 1), ('V2', 'Brand#5', 0), ('V2', 'Brand#1', 1) AS a(vocab, sab, prio)")
    return concepts.alias_lookup(atoms(spark, sf_dir).select("cui", "sab", "code"), aliases).select("vocab", "cui", "code")


@query(f"""WITH {ATOMS}, told AS (SELECT cui, lat, CASE p_partkey % 5 WHEN 0 THEN 'MSH' WHEN 1 THEN 'SNOMEDCT_US' WHEN 2 THEN 'SCTSPA' WHEN 3 THEN 'MDRFRE' ELSE 'HL7V3.0' END AS sab, tty, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(p_partkey % 900 AS VARCHAR) END AS code, str, line_no FROM atoms JOIN part ON line_no = p_partkey),
  used AS (SELECT DISTINCT 'C' || lpad(CAST(l_partkey % 500 AS VARCHAR), 7, '0') AS cui FROM lineitem WHERE l_quantity > 30), k AS (SELECT * FROM told WHERE lat = 'ENG' AND sab IN ('MSH', 'SNOMEDCT_US', 'HL7V3.0') AND code <> '' AND cui IN (SELECT cui FROM used)),
  g AS (SELECT cui, sab, code, tty, min(line_no) AS first_at FROM k GROUP BY ALL) SELECT cui, sab, code, string_agg(tty, '|' ORDER BY first_at) AS tty, (SELECT arg_max(str, line_no) FROM k WHERE k.cui = g.cui AND k.sab = g.sab AND k.code = g.code) AS term FROM g GROUP BY cui, sab, code""")
def crosswalk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the concepts that mentions have: by English atoms of allowed sources, foreign ones beside them."""
    k = F.col("line_no")
    sab = F.when(k % 5 == 0, "MSH").when(k % 5 == 1, "SNOMEDCT_US").when(k % 5 == 2, "SCTSPA").when(k % 5 == 3, "MDRFRE").otherwise("HL7V3.0")
    told = atoms(spark, sf_dir).withColumns({"sab": sab, "code": F.when(k % 11 == 0, "").otherwise((k % 900).cast("string"))})
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("C"), F.lpad((F.col("l_partkey") % 500).cast("string"), 7, "0")).alias("cui"))
    return concepts.crosswalk(told, used)


@query(f"WITH {ATOMS} SELECT DISTINCT cui FROM atoms WHERE sab IN ('Brand#13', 'Brand#5')")
def vocab_cui_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.usable(atoms(spark, sf_dir), ["Brand#13", "Brand#5"]).select("cui").distinct()


@query("SELECT DISTINCT 'C' || p_partkey AS cui FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cui = lambda c: F.concat(F.lit("C"), F.col(c).cast("string")).alias("cui")
    return hierarchy.resume(table(spark, sf_dir, "part").select(cui("p_partkey")).distinct(), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(cui("l_partkey")))


# Statistics.

_LINES = """lines AS (SELECT o_orderstatus AS dataset, l_orderkey AS doc_id, l_linenumber AS start, l_linenumber + 5 AS stop, l_shipdate AS text, CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN 'CUI-less' ELSE 'C' || l_partkey END AS cui FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_HAS = "cui <> '' AND cui <> 'CUI-less'"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cui = F.when(F.col("l_partkey") % 11 == 0, "").when(F.col("l_partkey") % 13 == 0, "CUI-less").otherwise(F.concat(F.lit("C"), F.col("l_partkey").cast("string")))
    return rows.select(F.col("o_orderstatus").alias("dataset"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 5).alias("end"), F.col("l_shipdate").alias("text"), cui.alias("cui"))


_BASIC = f"""b AS (SELECT dataset, count(DISTINCT doc_id) AS documents, count(*) AS mentions, count(DISTINCT text) AS texts, count(DISTINCT (doc_id, start, stop)) AS spans, count(DISTINCT CASE WHEN {_HAS} THEN cui END) AS concepts,
  count(*) FILTER (WHERE {_HAS}) AS mapped, count(*) FILTER (WHERE NOT ({_HAS})) AS unmapped FROM lines GROUP BY dataset)"""


@query(f"WITH {_LINES}, {_BASIC} SELECT * FROM b")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.basic(_lines(spark, sf_dir), ["dataset"])


def _counted(key: str) -> str:
    return f"""count(DISTINCT {key}doc_id)) AS documents, count(*) AS mentions, count(DISTINCT text) AS texts, count(DISTINCT {key}doc_id, start, stop)) AS spans, count(DISTINCT CASE WHEN {_HAS} THEN cui END) AS concepts,
  count(*) FILTER (WHERE {_HAS}) AS mapped, count(*) FILTER (WHERE NOT ({_HAS})) AS unmapped FROM lines"""


@query(f"WITH {_LINES} SELECT dataset, false AS everything, {_counted('(')} GROUP BY dataset UNION ALL SELECT NULL, true, {_counted('(dataset, ')}")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset, and all of them at once."""
    return statistics.rollup(_lines(spark, sf_dir))


@query(f"WITH {_LINES}, {_BASIC} SELECT dataset, round(mapped / mentions, 9) AS mapping_rate, round(mentions / documents, 9) AS mentions_a_document, round(mapped / concepts, 9) AS mentions_a_concept FROM b")
def doc_stats_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.rates(statistics.basic(_lines(spark, sf_dir), ["dataset"]))
    return out.select("dataset", *[F.round(c, 9).alias(c) for c in ("mapping_rate", "mentions_a_document", "mentions_a_concept")])


@query(f"""WITH {_LINES}, d AS (SELECT dataset, doc_id, count(*) AS n FROM lines GROUP BY 1, 2) SELECT dataset, round(avg(n), 9) AS mean, CAST(median(n) AS DOUBLE) AS median, min(n) AS least, max(n) AS greatest, round(stddev_pop(n), 9) AS deviation FROM d GROUP BY dataset""")
def mention_len_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lines(spark, sf_dir).groupBy("dataset", "doc_id").agg(F.count("*").alias("n"))
    return statistics.summary(n, "n", ["dataset"]).withColumns({"mean": F.round("mean", 9), "deviation": F.round("deviation", 9)})


_SOURCE = """s AS (SELECT CASE l_linenumber % 2 WHEN 0 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS specific, CAST(l_suppkey AS VARCHAR) AS general,
  CASE l_linenumber % 5 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_suppkey AS VARCHAR) WHEN 2 THEN 'C' || l_partkey WHEN 3 THEN 'X' || l_partkey ELSE '' END AS native, CASE WHEN l_quantity > 40 THEN '' ELSE 'C' || l_partkey END AS cui FROM lineitem)"""


@query(f"""WITH {_SOURCE} SELECT CASE WHEN cui = '' THEN 'unmapped' WHEN specific <> '' AND specific = native THEN 'specific' WHEN general <> '' AND general = native THEN 'general' WHEN native LIKE 'C%' THEN 'cui_validation' WHEN native <> '' THEN 'ontology_id' ELSE 'text' END AS source, count(*) AS n FROM s GROUP BY 1""")
def mapping_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, k = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    native = F.when(k % 5 == 0, p).when(k % 5 == 1, s).when(k % 5 == 2, F.concat(F.lit("C"), p)).when(k % 5 == 3, F.concat(F.lit("X"), p)).otherwise("")
    rows = table(spark, sf_dir, "lineitem").select(F.when(k % 2 == 0, p).otherwise("").alias("specific"), s.alias("general"), native.alias("native"), F.when(F.col("l_quantity") > 40, "").otherwise(F.concat(F.lit("C"), p)).alias("cui"))
    return rows.groupBy(statistics.mapping_source("specific", "general", "native", "cui").alias("source")).agg(count())


@query("""WITH m AS (SELECT l_returnflag AS dataset, CASE l_linenumber % 6 WHEN 0 THEN 'CUI-less' WHEN 1 THEN 'nan' WHEN 2 THEN 'C' || l_partkey WHEN 3 THEN 'C' || l_suppkey WHEN 4 THEN NULL ELSE '' END AS native_id, CASE WHEN l_quantity > 40 THEN '' WHEN l_quantity > 38 THEN NULL ELSE 'C' || l_partkey END AS cui FROM lineitem)
  SELECT dataset, count(*) FILTER (WHERE cui <> '' AND coalesce(native_id, '') IN ('', 'nan')) AS originally_no_concept, count(*) FILTER (WHERE cui <> '' AND native_id = 'CUI-less') AS originally_cui_less,
  count(*) FILTER (WHERE cui <> '' AND native_id LIKE 'C%' AND native_id <> cui) AS cui_validation_success, count(*) FILTER (WHERE cui <> '' AND coalesce(native_id, '') = '') AS fallback_success FROM m GROUP BY dataset""")
def mapping_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What linking has mended, by dataset."""
    k, coded = F.col("l_linenumber") % 6, lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    native = F.when(k == 0, "CUI-less").when(k == 1, "nan").when(k == 2, coded("l_partkey")).when(k == 3, coded("l_suppkey")).when(k == 4, F.lit(None)).otherwise("")
    cui = F.when(F.col("l_quantity") > 40, "").when(F.col("l_quantity") > 38, F.lit(None)).otherwise(coded("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), native.alias("native_id"), cui.alias("cui"))
    return statistics.mapping_improvements(rows, ["dataset"])


@query(f"""WITH {_SOURCE} SELECT count(*) FILTER (WHERE native = '' AND cui <> '') AS from_nothing, count(*) FILTER (WHERE native LIKE 'C%' AND cui <> '' AND native = cui) AS validated, count(*) FILTER (WHERE native LIKE 'C%' AND cui <> '' AND native <> cui) AS corrected, count(*) FILTER (WHERE cui = '') AS lost FROM s""")
def improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, k = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    native = F.when(k % 5 == 0, p).when(k % 5 == 1, s).when(k % 5 == 2, F.concat(F.lit("C"), p)).when(k % 5 == 3, F.concat(F.lit("X"), p)).otherwise("")
    rows = table(spark, sf_dir, "lineitem").select(native.alias("native"), F.when(F.col("l_quantity") > 40, "").otherwise(F.concat(F.lit("C"), p)).alias("cui"))
    return rows.agg(
        F.count_if((F.col("native") == "") & (F.col("cui") != "")).alias("from_nothing"),
        F.count_if(F.col("native").startswith("C") & (F.col("cui") != "") & (F.col("native") == F.col("cui"))).alias("validated"),
        F.count_if(F.col("native").startswith("C") & (F.col("cui") != "") & (F.col("native") != F.col("cui"))).alias("corrected"),
        F.count_if(F.col("cui") == "").alias("lost"),
    )


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def counters_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top(table(spark, sf_dir, "lineitem"), "l_partkey", 20)


@query(f"""WITH {_LINES}, x AS (SELECT DISTINCT dataset, cui, 'S' || (start % 3) AS sab, 'K' || (start % 2) AS code, dataset || start AS tty FROM lines WHERE {_HAS})
  SELECT cui, sab, code, arg_max(tty, dataset || tty) AS tty, count(DISTINCT dataset) AS datasets FROM x GROUP BY 1, 2, 3""")
def cross_dataset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where(statistics.HAS_CUI).select("dataset", "cui", F.concat(F.lit("S"), (F.col("start") % 3).cast("string")).alias("sab"), F.concat(F.lit("K"), (F.col("start") % 2).cast("string")).alias("code"), F.concat("dataset", F.col("start").cast("string")).alias("tty"))
    latest = rows.groupBy("dataset", "cui", "sab", "code").agg(F.max("tty").alias("tty"))
    return concepts.merged([latest.where(F.col("dataset") == d) for d in ("F", "O", "P")])


@query(f"""WITH {_LINES}, q AS (SELECT DISTINCT dataset, cui FROM lines WHERE {_HAS}), s AS (SELECT cui, count(*) AS k, min(dataset) AS dataset FROM q GROUP BY cui)
  SELECT q.dataset, count(*) AS concepts, count(*) FILTER (WHERE s.k = 1) AS own, round(count(*) / (SELECT count(*) FROM s), 9) AS coverage FROM q JOIN s ON q.cui = s.cui GROUP BY q.dataset""")
def cross_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.across(_lines(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


@query("SELECT doc_id, CASE WHEN doc_id % 100 < 10 THEN 'dev' WHEN doc_id % 100 < 50 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 100
    return table(spark, sf_dir, "documents").select("doc_id", F.when(k < 10, "dev").when(k < 50, "test").otherwise("train").alias("split"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def semantic_group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.shares(table(spark, sf_dir, "events"), "event_type")


@query("SELECT d.name AS domain, count(*) AS n FROM documents JOIN (SELECT * FROM (VALUES ('en', 'literature'), ('de', 'clinical'), ('fr', 'clinical'), ('es', 'social')) AS v(lang, name)) d ON documents.lang = d.lang GROUP BY 1")
def domain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.sql("SELECT * FROM VALUES ('en', 'literature'), ('de', 'clinical'), ('fr', 'clinical'), ('es', 'social') AS v(lang, domain)")
    return table(spark, sf_dir, "documents").join(F.broadcast(domains), "lang").groupBy("domain").agg(count())  # four rows


@query("""WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CAST(least(floor((n_chars - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n FROM documents, e GROUP BY 1""")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(table(spark, sf_dir, "documents"), "n_chars", 50)
