"""The concept service's questions, one by one."""

import pytest

from conceptloom.operators.service import ConceptService

ATOMS = [
    ("C0000001", "ENG", "Y", "MSH", "PT", "D100", "Cold", 0),
    ("C0000001", "ENG", "N", "MSH", "SY", "D100", "common cold", 1),
    ("C0000001", "FRE", "Y", "MSHFRE", "PT", "D100", "Rhume", 2),
    ("C0000002", "ENG", "Y", "SNOMEDCT_US", "PT", "386661006", "high fever of unknown origin", 3),
    ("C0000002", "ENG", "N", "SNOMEDCT_US", "SY", "12", "", 4),
    ("C0000003", "ENG", "N", "GO", "SY", "", "nameless", 5),
]


@pytest.fixture(scope="module")
def service(frame, tmp_path_factory):
    atoms = frame(ATOMS, "cui string, lat string, ispref string, sab string, tty string, code string, str string, line_no long")
    types = frame([("C0000001", "T184", 1), ("C0000001", "T047", 0), ("C0000002", "T033", 0), ("C0000001", "T047", 2)], "cui string, tui string, pos int")
    return ConceptService.build(atoms, types, str(tmp_path_factory.mktemp("service")))


def rows(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_questions(service, tmp_path):
    assert rows(service.validate("0000001")) == ["C0000001"] and rows(service.validate("C9")) == rows(service.validate("")) == rows(service.validate(None)) == []
    assert rows(service.atoms(" C0000002 ").select("line_no")) == [3, 4]
    assert rows(service.name("C0000001")) == [("C0000001", "common cold")] and rows(service.name("C0000003")) == [("C0000003", "nameless")]
    assert rows(service.closest_name("C0000001", "COLD")) == [("C0000001", "Cold")] and rows(service.closest_name("C7", "x")) == []
    assert rows(service.types("C0000001").select("tui")) == ["T047", "T184"] and rows(service.types("nan")) == []
    assert sorted(rows(service.codes("C0000002"))) == [("SNOMEDCT_US", ["12", "386661006"])]
    assert sorted(rows(service.codes_with_terms("C0000001"))) == [("MSH", "D100", "PT|SY", "common cold"), ("MSHFRE", "D100", "PT", "Rhume")]
    assert rows(service.concept_of_code("00386661006.0", "SNOMEDCT_US")) == ["C0000002"] and rows(service.concept_of_code("100", "MSH")) == ["C0000001"]
    assert rows(service.concept_of_code("", "MSH")) == rows(service.concept_of_code("D100", "nowhere")) == []
    assert rows(service.concept_of_text(" common COLD")) == [("C0000001", "exact_match")] and rows(service.concept_of_text("fever, origin")) == [("C0000002", "semantic_containment")]
    assert rows(service.concept_of_text("")) == rows(service.concept_of_text("nothing like it")) == []
    service.write_mappings(service.spark.createDataFrame([("0000001",), ("C0000002",), ("C8",)], "cui string"), str(tmp_path), "x")
    summary = service.spark.read.json(str(tmp_path / "x_enhanced_mapping_summary")).first()
    assert (summary.concepts, summary.with_codes, summary.sources) == (3, 2, "MSH MSHFRE SNOMEDCT_US")


def test_many_at_once(service, frame):
    got = {r.cui: (r.valid, r.name, r.types, r.codes) for r in service.records(frame([("0000001",), ("C0000001",), ("C0000003",), ("C5",), ("",), (None,)], "cui string")).collect()}
    assert got == {"C0000001": (True, "common cold", ["T047", "T184"], ["MSH:D100", "MSHFRE:D100"]), "C0000003": (True, "nameless", [], []), "C5": (False, None, [], [])}
    keys = frame([("MSH", "100"), ("SNOMEDCT_US", "0012"), ("GO", "D100"), ("MSH", None)], "sab string, code string")
    assert sorted(map(tuple, service.concepts_of_codes(keys).collect())) == [("MSH", "100", "C0000001"), ("SNOMEDCT_US", "0012", "C0000002")]


def test_questions_are_pushed_down(service):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "EqualTo(cui,C0000001)" in plan(service.validate("C0000001")) and "EqualTo(cui,C0000001)" in plan(service.types("C0000001"))
    found = plan(service.concept_of_code("D100", "MSH"))
    assert "EqualTo(sab,MSH)" in found and "In(code, [" in found
