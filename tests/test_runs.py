"""Service records, processed corpora and the three runs on small hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from conceptloom import drivers
from conceptloom.functions import codes
from conceptloom.operators import concepts, hierarchy, statistics
from conceptloom.sources import corpora, processed, sinks, taxonomies

ATOMS = "cui string, lat string, ispref string, sab string, tty string, code string, str string, line_no long"


@pytest.fixture
def put(tmp_path):
    def write(name, *records):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in records))
        return str(path)

    return write


def test_service_records(spark, put):
    concept = put("c.json", {"conceptId": "1", "active": True, "pt": {"term": "Root"}}, {"conceptId": "2", "active": False})
    parents = put("p.json", {"conceptId": "2", "parents": [{"conceptId": "1", "pt": {"term": "Root"}}]}, {"conceptId": "3", "parents": {"items": [{"conceptId": "2"}, {"conceptId": "1"}]}}, {"conceptId": "1", "parents": []})
    nodes, edges = taxonomies.snomed(spark, concept, parents)
    assert {tuple(r) for r in nodes.collect()} == {("1", "Root", True), ("2", "N/A", False)}
    assert {(r.child, r.parent, r.name) for r in edges.collect()} == {("2", "1", "Root"), ("3", "2", "N/A"), ("3", "1", "N/A")}
    prop = lambda kind, code: {"name": "property", "part": [{"name": "code", "valueCode": kind}, {"name": "value", "valueCoding": {"code": code}}]}
    nodes, edges = taxonomies.loinc(spark, put("l.json", {"code": "2339-0", "parameter": [{"name": "display", "valueString": "Glucose"}, prop("parent", "LP1-1"), prop("child", "x"), prop("parent", "LP2-2")]}, {"code": "LP1-1"}))
    assert {tuple(r) for r in nodes.collect()} == {("2339-0", "Glucose"), ("LP1-1", None)}
    assert [(r.child, r.parent) for r in edges.orderBy("pos").collect()] == [("2339-0", "LP1-1"), ("2339-0", "LP2-2")]
    wide = taxonomies.meddra(spark, put("m.json", {"code": "5", "type": "PT", "soc_code": "1", "soc_name": "S", "pt_code": "5", "pt_name": "P", "llt_code": "5", "llt_name": "P"}, {"code": "6", "soc_code": "1", "soc_name": "S", "pt_code": "5", "pt_name": "P", "llt_code": "6", "llt_name": "L"}))
    assert {r.code: [x.code for x in r.path] for r in taxonomies.meddra_paths(wide).collect()} == {"5": ["1", "5"], "6": ["1", "5", "6"]}
    taxa = put("t.xml", "<TaxaSet><Taxon><TaxId>9606</TaxId><ScientificName>Homo sapiens</ScientificName><LineageEx><Taxon><TaxId>1</TaxId><ScientificName>root</ScientificName></Taxon><Taxon><TaxId>9605</TaxId><ScientificName>Homo</ScientificName></Taxon></LineageEx></Taxon></TaxaSet>")
    assert [(x.code, x.name) for x in taxonomies.ncbi_lineages(spark, taxa).first().path] == [("1", "root"), ("9605", "Homo"), ("9606", "Homo sapiens")]


def test_line_ends_and_concept_names(spark, frame, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1|t|One\r\n1|a|\r\n1\t0\t3\tOne\tD\tD1\r\n\r\n2|t|Two\r\n2\t0\t3\tTwo\tD\tD2\r\n")
    assert {(r.doc_id, r.text, r.concept) for r in corpora.pubtator(spark, str(tmp_path / "a.txt")).collect()} == {("1", "One", "D1"), ("2", "Two", "D2")}
    names = [("Pain | 10 14", "Pain"), ("+| or Ache 10 14;20 24", "Ache"), ("| 3 9", "Unknown concept"), (" plain ", "plain"), ("", "")]
    got = frame([(a,) for a, _ in names], "a string").select("a", corpora.concept_name(F.col("a")).alias("b")).collect()
    assert {(r.a, r.b) for r in got} == set(names)


def test_descriptor_paths(spark, frame):
    trees = frame([("C06", "D1", "Digestive"), ("C06.552", "D2", "Liver"), ("X01.5", "D3", "Odd")], "tree string, code string, name string")
    got = {r.code: [(x.code, x.name) for x in r.path] for r in hierarchy.descriptor_paths(trees).collect()}
    assert got["D2"] == [("C", "Diseases"), ("D1", "Digestive"), ("D2", "Liver")] and got["D3"] == [("X", "Unknown: X"), ("X01", "Unknown: X01"), ("D3", "Odd")]


def test_a_corpus_is_linked_and_written(spark, frame, tmp_path):
    atoms = frame([("C0000001", "ENG", "Y", "MSH", "PT", "D100", "cold", 0), ("C0000001", "ENG", "N", "GO", "SY", "GO:0000001", "a cold", 1), ("C0000002", "ENG", "Y", "MSH", "PT", "D200", "fever", 2)], ATOMS)
    types = frame([("C0000001", "T047", 0), ("C0000001", "T184", 1), ("C0000002", "T033", 2)], "cui string, tui string, pos int")
    rows = frame([("1", "train", "cold and fever", 0, 4, "cold", "D100", "MSH"), ("1", "train", "cold and fever", 9, 14, "fever", "", ""), ("2", "test", "odd", 0, 3, "odd", None, None)], "doc_id string, split string, doc_text string, start int, end int, text string, native_id string, native_ontology_name string")
    corpus = drivers.Corpus("small", "cdr", lambda spark: rows)
    out = str(tmp_path / "out")
    assert drivers.process_corpora(spark, [corpus], atoms, types, out, "_v1") == {"small": 3}
    docs = spark.read.json([f"{out}/small_v1/documents/small_{s}.jsonl" for s in ("train", "test")])
    again = drivers.summarise(spark, out, ["small"], "_v1").first()
    assert (again.documents, again.mentions, again.mapped) == (2, 3, 2)
    got = {(r.doc_id, m.text, m.cui, m.umls_name, m.semantic_type, m.mapping_method) for r in docs.collect() for m in r.mentions}
    assert got == {("1", "cold", "C0000001", "a cold", "T047", "native_id_mapping"), ("1", "fever", "C0000002", "fever", "T033", "exact_match"), ("2", "odd", "", "", "", "no_mapping")}
    at = f"{out}/small_v1/mappings/small_"
    assert {r.cui: r.tuis for r in spark.read.json(at + "cui_to_tuis").collect()} == {"C0000001": ["T047", "T184"], "C0000002": ["T033"]}
    summary = spark.read.json(at + "enhanced_mapping_summary").first()
    assert (summary.concepts, summary.codes, summary.sources, summary.types_coverage) == (2, 3, "GO MSH", 1.0)
    assert {r.sab: (r.codes, r.top) for r in spark.read.json(at + "tty_statistics").collect()} == {"MSH": (2, "PT=2"), "GO": (1, "SY=1")}
    assert drivers.link_corpus(corpus, spark, atoms, types, most_documents=1).select("doc_id").distinct().count() == 1
    walk = drivers.crosswalk_of(drivers.link_corpus(corpus, spark, atoms, types), atoms).withColumn("dataset", F.lit("small"))
    sinks.combined_files(walk, types, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all" / "combined_cui_to_vocab_codes")).count() == 2


def test_paths_resume_where_a_run_stopped(spark, frame, tmp_path):
    walk = frame([("C1", "MSH", "b"), ("C2", "MSH", "bad!"), ("C3", "MSH", "lost")], "cui string, sab string, code string")
    edges = frame([("b", "a")], "child string, parent string")
    aliases = frame([("MESH", "MSH", 0)], "vocab string, sab string, prio int")
    vocabulary = drivers.Vocabulary("MESH", lambda c: c.rlike("^[a-z]+$"), lambda rows: hierarchy.walk_up(rows, edges))
    out = str(tmp_path / "paths")
    status = {(r.cui, r.status, r.n_paths) for r in drivers.extract_paths(spark, walk, [vocabulary], aliases, out).collect()}
    assert status == {("C1", "success", 1), ("C2", "error", 0), ("C3", "not_found", 0)}
    again = drivers.extract_paths(spark, walk, [vocabulary], aliases, out)
    assert {r.cui for r in again.collect()} == {"C2", "C3"} and sinks.paths_of(spark, out, "MESH").count() == 1
    stats = statistics.vocabulary_statistics(again).first()
    assert (stats.codes, stats.with_paths, stats.errors, stats.coverage) == (2, 0, 1, 0.0)


def test_a_resumed_run_tells_the_same_as_one_run(spark, frame, tmp_path):
    walk = frame([(f"C{k:07}", "LNC", c) for k, c in enumerate(["1000-1", "1000-2", "MTHU000001", "bad!", "LP0001-1", "9999-9"])], "cui string, sab string, code string")
    edges = frame([("1000-1", "LP0001-1"), ("1000-2", "1000-1"), ("1000-2", "LP0001-1")], "child string, parent string")
    aliases = frame([("LNC", "LNC", 0)], "vocab string, sab string, prio int")
    vocabulary = drivers.known_vocabulary("LNC", edges)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    drivers.extract_paths(spark, walk, [vocabulary], aliases, whole)
    ledger = spark.read.json(f"{whole}/ledger").first()
    assert (ledger.codes, ledger.success, ledger.errors, ledger.skipped_mthu, ledger.nothing, ledger.paths, ledger.nodes, ledger.longest, ledger.stopped) == (6, 4, 1, 1, 0, 5, 9, 3, False)
    got = drivers.run_statistics(spark, whole).first()
    assert (got.concepts, got.codes, got.with_paths, got.paths, got.errors, got.skipped_mthu, got.concepts_with_paths) == (6, 6, 4, 5, 1, 1, 4)
    assert got.error_rate == pytest.approx(1 / 6) and got.paths_a_concept == pytest.approx(5 / 6)
    # one error is too many: batches after it wait for another run
    drivers.extract_paths(spark, walk, [vocabulary], aliases, parts, batches=3, most_errors=1)
    first = spark.read.json(f"{parts}/ledger")
    assert first.agg(F.max("stopped")).first()[0] == (first.count() < 3)
    drivers.extract_paths(spark, walk, [vocabulary], aliases, parts)
    assert drivers.run_statistics(spark, parts).collect() == drivers.run_statistics(spark, whole).collect()
    assert [tuple(r) for r in spark.read.json(f"{parts}/statistics").collect()] == [tuple(r) for r in spark.read.json(f"{whole}/statistics").collect()]


def test_vocabularies_go_up_their_own_ways(spark, frame):
    pairs = frame([("b", "a"), ("c", "b"), ("c", "x"), ("l", "m"), ("m", "l")], "child string, parent string")
    dag = frame([("b", "a"), ("c", "b"), ("c", "x")], "child string, parent string")
    codes = frame([(c,) for c in "abclkz"], "code string")
    nodes = frame([(c, c != "b") for c in "abclmk"], "code string, active boolean")
    ways = lambda name, edges, nodes=None: sorted((r.code, ".".join(r.path)) for r in drivers.known_vocabulary(name, edges, nodes).paths(codes).collect())
    up = [("a", "a"), ("b", "a.b"), ("c", "a.b.c"), ("c", "x.c")]
    assert ways("GO", dag, nodes.select("code")) == [*up, ("k", "k"), ("l", "l")] and ways("HPO", dag) == up
    assert ways("NCI_V2", pairs) == [*up, ("k", "k"), ("z", "z")]
    assert ways("LCH_NW", pairs, nodes.select("code")) == [("a", "a"), ("b", "a.b"), ("c", "a.b.c"), ("k", "k"), ("l", "m.l"), ("z", "z")]
    assert ways("SNOMEDCT_US", dag, nodes) == [("a", "a"), ("c", "a.b.c"), ("c", "x.c"), ("k", "k"), ("l", "l")]
    assert drivers.known_vocabulary("SNOMEDCT_US_V2", dag).name == "SNOMEDCT_US_V2"


def test_processed_corpora(spark, put, tmp_path):
    doc = {"doc_id": "1", "text": "cold", "split": "train", "mentions": [{"start": 0, "end": 4, "text": "cold", "cui": "C1"}, {"start": 0, "end": 4, "text": "cold", "cui": ""}]}
    put("d/x/x_train.jsonl", doc)
    put("d/x/x_dev.jsonl", doc | {"doc_id": "2"})
    row = drivers.summarise(spark, str(tmp_path / "d"), ["x", "absent"]).first()
    assert (row.dataset, row.documents, row.mentions, row.spans, row.concepts, row.mapped, row.unmapped, row.mapping_rate) == ("x", 2, 4, 2, 1, 2, 2, 0.5)
    with pytest.raises(FileNotFoundError):
        drivers.summarise(spark, str(tmp_path / "d"), ["absent"])
    assert not processed.must_have(spark, str(tmp_path / "no"), "cadec", ["cadec"])
    with pytest.raises(FileNotFoundError):
        processed.must_have(spark, str(tmp_path / "no"), "cdr", ["cadec"])
    groups = put("g.json", {"semantic_groups": {"DISO": {"name": "Disorders", "types": {"T047": {"name": "Disease"}}}}})
    assert [tuple(r) for r in processed.semantic_groups(spark, groups).collect()] == [("T047", "DISO", "Disorders", "Disease")]
    assert processed.vocabulary_list(put("v.json", {"vocabularies": [{"id": 2, "name": "B"}, {"id": 1, "name": "A"}]})) == ["A", "B"]
    assert processed.restricted(put("r.txt", ["a", "b"])) == ["a", "b"]
    assert [processed.Versions({"X": "1"}, "0", o).of(v) for v, o in (("X", None), ("Y", None), ("X", "9"))] == ["1", "0", "9"]


def test_small_reports(spark, frame):
    assert len(concepts.ALLOWED_SOURCES) == len(set(concepts.ALLOWED_SOURCES)) == 74
    found = frame([("d", 3), ("d", -1), ("e", None)], "entity_type string, start int")
    assert {r.entity_type: (r.total, r.found, r.lost, r.percent) for r in statistics.cleaning_report(found).collect()} == {"d": (2, 1, 1, 50.0), "e": (1, 0, 1, 0.0)}
    kinds = frame([("HTTP 404",), ("Read timeout",), ("odd",), (None,)], "m string").select("m", statistics.error_kind(F.col("m")).alias("k")).collect()
    assert {r.m: r.k for r in kinds} == {"HTTP 404": "not_found", "Read timeout": "timeout", "odd": "other", None: None}
    rows = frame([("CUI-less",), ("cui_less",), ("",), (None,), ("C1",)], "cui string")
    assert tuple(statistics.nothing_said(rows).first()) == (2, 2)
    assert statistics.stress_sample(rows.where("cui is not null"), 2).collect() == statistics.stress_sample(rows.where("cui is not null"), 2).collect()
    assert frame([("CONCEPT-LESS",), ("x",)], "c string").where(codes.conceptless(F.col("c"))).count() == 1
