"""Readers on small hand-written files."""

import pytest
from pyspark.sql import functions as F

from conceptloom.operators import hierarchy
from conceptloom.sources import corpora, sinks, vocabularies


@pytest.fixture
def folder(tmp_path):
    def put(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))
        return str(path)

    return put


PUBTATOR = "1|t|Bad cold\n1|a|A cold é came.\n1\t0\t8\tBad cold\tDisease\tD1|D2\n1\t11\t15\tcold\tT047,T033\tC1\n1\tCID\tD1\tD2\n1\tx\t3\tBad\tDisease\tD1\n\n2|t|Title only\n2\t0\t5\tTitle\tDisease\t-1\n"


def test_pubtator(spark, folder):
    got = corpora.pubtator(spark, folder("a.txt", PUBTATOR), "train").orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.start, r.end, r.text, r.concept, r.split) for r in got] == [("1", 0, 8, "Bad cold", "D1|D2", "train"), ("1", 11, 15, "cold", "C1", "train"), ("2", 0, 5, "Title", "-1", "train")]
    assert all(r.doc_text[r.start : r.end] == r.text for r in got)
    assert got[0].doc_text == "Bad cold A cold é came." and got[2].doc_text == "Title only"


def test_pubtator_splits(spark, folder):
    rows = corpora.pubtator_splits(spark, folder("a.txt", PUBTATOR), {"train": folder("tr", "1\n"), "test": folder("te", "1\n\n")})
    assert {(r.doc_id, r.split, r.semantic_type) for r in rows.collect()} == {("1", "train", ""), ("1", "train", "T047"), ("2", "unknown", "")}


def test_standoff(spark, folder, tmp_path):
    folder("brat/a.txt", "One two.\n")
    folder("brat/a.ann", "T1\tC0000001 0 3\tOne\n#1\tnote\tx\nT2\tC2 4 7;8 9\ttwo\nT3\tC3 4 99\tx\n")
    got = corpora.standoff_pairs(spark, str(tmp_path / "brat"), str(tmp_path / "brat")).collect()
    assert [(r.doc_id, r.start, r.end, r.text, r.code, r.doc_text) for r in got] == [("a", 0, 3, "One", "C0000001", "One two.\n")]


def test_dual_standoff(spark, folder, tmp_path):
    folder("text/d.txt", "sore arm now", "latin-1")
    folder("text/e.txt", "  ", "latin-1")
    folder("sct/d.ann", "T1\t11 | Sore | 0 4\tx\nT2\tCONCEPT_LESS 5 8\tarm\n", "latin-1")
    folder("md/d.ann", "T1\t99 0 4\tsore\nT2\t77 9 12\tnow\n", "latin-1")
    got = corpora.dual_standoff(spark, *(str(tmp_path / p) for p in ("text", "sct", "md"))).orderBy("start").collect()
    assert [(r.start, r.text, r.first_id, r.second_id, r.native_id) for r in got] == [(0, "sore", "11", "99", "11"), (5, "arm", "CONCEPT_LESS", None, "CONCEPT_LESS"), (9, "now", None, "77", "77")]


def test_tabular(spark, folder):
    path = folder("t.csv", "ID\tTerm\tGeneral SNOMED ID\tSpecific SNOMED ID\tExample\n7\tfever\t386661006\tnan\tHigh Fever today\n8\tzz\t1.0\t2\tnone\n")
    got = corpora.tabular(spark, path, "dev").orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.end, r.general_id, r.specific_id) for r in got] == [("row_dev_7", 5, 10, "386661006", ""), ("row_dev_8", 0, 2, "1", "2")]


def test_labels(spark, folder):
    xml = """<Label drug="X" track="T"><Text><Section id="S1" name="a">Pain here.</Section><Section id="S2" name="b">Some rash.</Section></Text>
<Mentions><Mention id="M1" section="S2" type="AdverseReaction" start="5" len="4" str="rash"/><Mention id="M2" section="S1" type="Severity" start="0,5" len="4,4" str="Pain here"/></Mentions>
<Reactions><Reaction id="R1" str="Rash"><Normalization id="N" meddra_pt="Rash" meddra_pt_id="10037844"/></Reaction></Reactions></Label>"""
    rows = corpora.labels(spark, folder("x.xml", xml)).collect()
    assert [(r.doc_id, r.start, r.end, r.text, r.code) for r in rows] == [("X", 17, 21, "rash", "10037844")]
    assert rows[0].doc_text[17:21] == "rash"
    assert corpora.labels(spark, folder("x.xml", xml), keep_parts=True).count() == 3


def test_notes_and_pipes(spark, folder, tmp_path):
    notes = folder("n.csv", 'note_id,text\n1,"two\nlines"\n')
    marks = folder("m.csv", "note_id,start,end,concept_id\n1,4,9,55\n2,0,1,66\n")
    assert [(r.doc_id, r.text, r.code) for r in corpora.notes(spark, notes, marks).collect()] == [("1", "lines", "55")]
    folder("r/q.txt", "left arm pain")
    folder("p/q.pipe", "q.txt|0-4,9-13|C1|xq.txt|5-8|CUI-less|q.txt|5-8|C2|")
    got = corpora.pipe_standoff(spark, str(tmp_path / "r"), str(tmp_path / "p")).orderBy("start").collect()
    assert [(r.text, r.code) for r in got] == [("left", "C1"), ("arm", "C2"), ("pain", "C1")]


def test_release_tables(spark, folder):
    row = lambda cui, lat, pref, sab, tty, code, name: f"{cui}|{lat}|||||{pref}|||||{sab}|{tty}|{code}|{name}|||\n"
    path = folder("c.rrf", row("C1", "ENG", "Y", "MSH", "PT", "D1", "Cold") + "short|row\n\n" + row("C2", "FRE", "N", "MSH", "SY", "D2", "Rhume"))
    got = vocabularies.atoms(spark, path).orderBy("line_no").collect()
    assert [(r.cui, r.lat, r.sab, r.tty, r.code, r.str) for r in got] == [("C1", "ENG", "MSH", "PT", "D1", "Cold"), ("C2", "FRE", "MSH", "SY", "D2", "Rhume")]
    assert [(r.cui, r.tui) for r in vocabularies.semantic_types(spark, folder("s.rrf", "C1|T047|A|Disease|x|\n")).collect()] == [("C1", "T047")]


def test_ontologies(spark, folder):
    obo = "format: 1\n\n[Term]\nid: GO:1\nname: root\n\n[Term]\nid: GO:2\nname: leaf\nis_a: GO:1 ! root\n\n[Term]\nid: GO:3\nname: old\nis_obsolete: true\nis_a: GO:1\n"
    nodes, edges = vocabularies.obo(spark, folder("a.obo", obo))
    assert {(r.code, r.name) for r in nodes.collect()} == {("GO:1", "root"), ("GO:2", "leaf")}
    assert [(r.child, r.parent) for r in edges.collect()] == [("GO:2", "GO:1")]
    xml = "<S><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Eye</String></DescriptorName><TreeNumberList><TreeNumber>A01</TreeNumber><TreeNumber>A02.1</TreeNumber></TreeNumberList></DescriptorRecord></S>"
    assert {(r.tree, r.code, r.name) for r in vocabularies.descriptor_trees(spark, folder("m.xml", xml)).collect()} == {("A01", "D1", "Eye"), ("A02.1", "D1", "Eye")}
    owl = '<rdf><owl:Class rdf:about="http://x#C2"><rdfs:label>Two</rdfs:label><rdfs:subClassOf rdf:resource="http://x#C1"/></owl:Class></rdf>'
    _, edges = vocabularies.owl(spark, folder("o.owl", owl))
    assert [(r.child, r.parent) for r in edges.collect()] == [("C2", "C1")]
    lines = '{"@graph":[{"@id":"http://x/sh1","@type":"skos:Concept","skos:prefLabel":{"@value":"One"},"skos:broader":{"@id":"http://x/sh2"}},{"@id":"http://x/p","@type":"other"}]}\n{"@id":"http://x/sh3","@type":"skos:Concept","skos:prefLabel":"Three","skos:broader":[{"@id":"http://x/sh1"},{"@id":"http://x/sh2"}]}\n'
    nodes, edges = vocabularies.json_ld(spark, folder("l.jsonl", lines))
    assert {(r.code, r.name) for r in nodes.collect()} == {("sh1", "One"), ("sh3", "Three")}
    assert {(r.child, r.parent) for r in edges.collect()} == {("sh1", "sh2"), ("sh3", "sh1"), ("sh3", "sh2")}
    codes = vocabularies.code_lines(spark, folder("icd.txt", "A01 Typhoid\nA01.1 Carrier state\nA01.12 Other\n"))
    assert {(r.child, r.parent) for r in hierarchy.icd_parents(codes).collect()} == {("A01.1", "A01"), ("A01.12", "A01.1")}


def test_crosswalk_shapes(spark, folder, tmp_path):
    text = '{"C1":{"MSH":{"codes":["D1","D2"],"code_meta":{"D1":{"tty":"PT"}}},"GO":{"GO:1":{"tty":"SY","term":"x"}},"NCI":["N1"]}}'
    got = vocabularies.crosswalk(spark, folder("w.json", text))
    assert {(r.cui, r.sab, r.code, r.tty) for r in got.collect()} == {("C1", "MSH", "D1", "PT"), ("C1", "MSH", "D2", None), ("C1", "GO", "GO:1", "SY"), ("C1", "NCI", "N1", None)}
    sinks.crosswalk_json(got.selectExpr("*", "'t' as term"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert [sinks.folder_of(x) for x in ("SNOMEDCT_US", "MDR_V2", "GO", "LNC")] == ["snomed", "meddra", "go", "loinc"]


def test_line_numbers_do_not_depend_on_files_and_splits(spark, folder, tmp_path):
    row = lambda k: f"C{k % 7:07}|ENG|||||Y|||||MSH|PT|D{k}|name {k % 5}|||\n"
    rows = [row(k) if k % 17 else "\n" for k in range(3000)]
    one = folder("one/c.rrf", "".join(rows))
    for k in range(200):
        folder(f"many/part-{k:03}.rrf", "".join(rows[15 * k : 15 * k + 15]))
    expected = {(f"D{k}", k) for k in range(3000) if k % 17}
    seen = []
    for path, size in ((one, "128m"), (one, "10k"), (str(tmp_path / "many"), "128m"), (str(tmp_path / "many"), "2k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            atoms = vocabularies.atoms(spark, path)
            seen.append(atoms.rdd.getNumPartitions())
            assert {(r.code, r.line_no) for r in atoms.collect()} == expected
            first = {r.cui: r.line_no for r in atoms.groupBy("cui").agg(F.min("line_no").alias("line_no")).collect()}
            assert first[f"C{0:07}"] == 7 and first[f"C{3:07}"] == 3
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(seen) > 10
    assert vocabularies.atoms(spark, folder("none/c.rrf", "")).isEmpty()


def test_stanzas_with_other_line_ends(spark, folder):
    text = "[Term]\r\nid: GO:1\r\nname: root\r\n\r\n[Term]\r\nid: GO:2\r\nname: leaf\r\nis_a: GO:1 ! root\r\n"
    nodes, edges = vocabularies.obo(spark, folder("a.obo", text))
    assert {(r.code, r.name) for r in nodes.collect()} == {("GO:1", "root"), ("GO:2", "leaf")} and [tuple(r) for r in edges.collect()] == [("GO:2", "GO:1")]
