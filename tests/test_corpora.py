"""The nine corpora from files of their own formats to linked documents and statistics."""

import pytest

from conceptloom import drivers
from conceptloom.operators import concepts
from conceptloom.sources import corpora, registry, sinks

ATOMS = "cui string, lat string, ispref string, sab string, tty string, code string, str string, line_no long"


@pytest.fixture
def put(tmp_path):
    def write(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))

    return write


@pytest.fixture
def release(frame):
    atoms = [
        ("C0000001", "ENG", "Y", "MSH", "PT", "D000100", "cold", 0),
        ("C0000001", "ENG", "N", "OMIM", "PT", "100", "a cold", 1),
        ("C0000002", "ENG", "Y", "SNOMEDCT_US", "PT", "386661006", "fever", 2),
        ("C0000002", "ENG", "Y", "MDR", "LT", "10016558", "fever high", 3),
        ("C0000002", "SPA", "Y", "SNOMEDCT_US", "PT", "77", "fiebre", 4),
        ("C0000003", "ENG", "Y", "SCTSPA", "PT", "5", "foreign pain", 5),
        ("C0000003", "ENG", "Y", "GO", "PT", "GO:0000003", "pain", 6),
    ]
    return frame(atoms, ATOMS), frame([("C0000001", "T047", 0), ("C0000002", "T033", 1), ("C0000003", "T184", 2)], "cui string, tui string, pos int")


def put_all(put):
    abstract = "1|t|Bad cold\n1|a|A cold came.\n"
    put("CDR_Data/CDR.Corpus.v010516/CDR_TrainingSet.PubTator.txt", abstract + "1\t4\t8\tcold\tDisease\tD000100|D000999\n1\tCID\tD1\tD2\n\n")
    put("CDR_Data/CDR.Corpus.v010516/CDR_TestSet.PubTator.txt", "2|t|Fever\n2\t0\t5\tFever\tDisease\t-1\n")
    put("NCBI/NCBItrainset_corpus.txt", abstract + "1\t4\t8\tcold\tDisease\tD000999+OMIM:100\n1\t11\t15\tcold\tDisease\tOMIM:100\n")
    put("NCBI/NCBIdevelopset_corpus.txt", "3|t|odd one\n3\t0\t3\todd\tDisease\t-\n")
    put("medmentions/corpus_pubtator.txt", "1|t|Old title\n1|a|gone.\n1\t0\t3\tOld\tT033\tC0000002\n\n4|t|Bad cold\n4\t4\t8\tcold\tT121,T047\tC0000001\n\n1|t|New pain\n1\t4\t8\tpain\tT184\tUMLS\n\n")
    put("medmentions/corpus_pubtator_pmids_trng.txt", "1\n")
    put("CADEC/cadec/text/P.1.txt", "high fever, d\xe9j\xe0 pain", "latin-1")
    put("CADEC/cadec/sct/P.1.ann", "TT1\t386661006 | High fever | 0 10\thigh fever\nTT2\tCONCEPT_LESS 17 21\tpain\n", "latin-1")
    put("CADEC/cadec/meddra/P.1.ann", "TT1\t10016558 0 10\thigh fever\nTT9\t123 17 21\tpain\n", "latin-1")
    put("cometa/splits/random/train.csv", "ID\tTerm\tGeneral SNOMED ID\tSpecific SNOMED ID\tExample\n7\tfever\t386661006\t1\tHigh fever today\n")
    put("cometa/splits/random/dev.csv", "ID\tTerm\tGeneral SNOMED ID\tSpecific SNOMED ID\tExample\n8\tpain\tnan\tnan\tsome pain\n")
    label = '<Label drug="{0}"><Text><Section id="S1" name="a">Some fever.</Section></Text><Mentions>{1}</Mentions><Reactions><Reaction id="R" str="fever"><Normalization id="N" meddra_pt="Fever" meddra_pt_id="10016558"/></Reaction></Reactions></Label>'
    mention = '<Mention id="M{0}" section="S1" type="AdverseReaction" start="{1}" len="5" str="fever"/>'
    put("ADR_cleaned/train/X.xml", label.format("X", mention.format(1, "5")))
    put("ADR_cleaned/train/Y.xml", label.format("Y", mention.format(1, "5") + mention.format(2, "0,5")))
    for folder in ("EMEA_one", "Medline_two"):
        put(f"Mantra-GSC/English/{folder}/u1.txt", "a cold day\n")
        put(f"Mantra-GSC/English/{folder}/u1.ann", "T1\tC0000001 2 6\tcold\n")
    put("MIMICIV_EL_cleaned_no_placeholders/mimic-iv_notes_training_set_cleaned.csv", 'note_id,text\nn1,"some\nfever"\n')
    put("MIMICIV_EL_cleaned_no_placeholders/train_annotations_cleaned.csv", "note_id,start,end,concept_id\nn1,5,10,386661006\nn2,0,1,1\n")


def test_nine_corpora(spark, put, release, tmp_path):
    atoms, types = release
    put_all(put)
    found = drivers.known_corpora(spark, str(tmp_path))
    assert [c.name for c in found] == [n for n in registry.CORPORA if n != "share"]  # licensed, and not there
    put("shareclef_cleaned/training_corpus/train/r1.txt", "left pain here")
    put("shareclef_cleaned/training_corpus/train_ann/r1.pipe.txt", "r1.txt|5-9|C0000003|x|r1.txt|0-4|CUI-less|")
    found = drivers.known_corpora(spark, str(tmp_path))
    out = str(tmp_path / "out")
    done = drivers.process_corpora(spark, found, atoms, types, out, "_v2")
    assert done == {"cdr": 3, "ncbi": 3, "medmentions": 3, "cadec": 2, "cometa": 2, "adr": 1, "mantra": 2, "mimic": 1, "share": 1}
    rows = {r.dataset: r for r in drivers.summarise(spark, out, list(registry.CORPORA), "_v2").collect()}
    assert {n: (r.documents, r.mentions, r.mapped) for n, r in rows.items()} == {"cdr": (2, 3, 3), "ncbi": (2, 3, 2), "medmentions": (2, 3, 3), "cadec": (1, 2, 2), "cometa": (2, 2, 2), "adr": (1, 1, 1), "mantra": (2, 2, 2), "mimic": (1, 1, 1), "share": (1, 1, 1)}
    whole = drivers.summarise_all(spark, out, list(registry.CORPORA), "_v2").where("everything").first()
    assert (whole.documents, whole.mentions, whole.mapped, whole.concepts) == (14, 18, 17, 3)
    read = lambda name, split="": {(d.doc_id, m.text): m for d in spark.read.json(f"{out}/{name}_v2/documents/{name}{split}.jsonl").collect() for m in d.mentions}
    train = spark.read.json(f"{out}/cdr_v2/documents/cdr_train.jsonl").first()
    assert train.split == "train" and [(m.native_id, m.cui, m.mapping_method) for m in train.mentions] == [("D000100", "C0000001", "native_id_mapping"), ("D000999", "C0000001", "exact_match")]
    assert "split" not in spark.read.json(f"{out}/ncbi_v2/documents/ncbi_train.jsonl").columns
    ncbi = read("ncbi", "_train")[("1", "cold")]
    assert (ncbi.entity_type, ncbi.cui, ncbi.native_ontology_name) == ("Disease", "C0000001", "OMIM")
    texts = {d.doc_id: d.text for s in ("_train", "") for d in spark.read.json(f"{out}/medmentions_v2/documents/medmentions{s}.jsonl").collect()}
    assert texts == {"1": "New pain", "4": "Bad cold"}  # the last block of an id has its text; ids of no list have no split
    assert read("medmentions")[("4", "cold")].semantic_types_full == "T121,T047"
    cadec = read("cadec")
    fever, pain = cadec[("P.1", "high fever")], cadec[("P.1", "pain")]
    assert (fever.snomed_id, fever.snomed_name, fever.meddra_id, fever.annotation_id, fever.native_ontology_name) == ("386661006", "High fever", "10016558", "TT1", "SNOMEDCT_US")
    assert (pain.snomed_id, pain.meddra_id, pain.native_id, pain.cui) == ("", "", "", "C0000003")
    cometa = read("cometa", "_train")[("cometa_train_7", "fever")]
    assert (cometa.native_id, cometa.specific_snomed_id, cometa.general_snomed_id, cometa.cui) == ("1", "1", "386661006", "C0000002")
    assert read("adr", "_train")[("X", "fever")].meddra_pt == "Fever"
    assert set(read("mantra")) == {("EMEA_one_u1", "cold"), ("Medline_two_u1", "cold")}
    assert read("mimic")[("n1", "fever")].annotation_id == "n1_5_10"
    walk = {(r.sab, r.code) for r in drivers.crosswalk_of(drivers.link_corpus(found[0], spark, atoms, types).unionByName(drivers.link_corpus(found[0], spark, atoms, types)), atoms).collect()}
    assert walk == {("MSH", "D000100"), ("OMIM", "100"), ("SNOMEDCT_US", "386661006"), ("MDR", "10016558")}  # neither Spanish atoms nor foreign sources


def test_a_split_is_written_anew(spark, frame, tmp_path):
    docs = lambda *rows: frame([(i, s, i, []) for i, s in rows], "doc_id string, split string, text string, mentions array<string>")
    at = str(tmp_path / "d")
    sinks.documents_by_split(docs(("1", "train"), ("2", None), ("3", "unknown"), ("4", "")), at, "x")
    put = lambda: sorted(p.name for p in (tmp_path / "d").iterdir())
    assert put() == ["x.jsonl", "x_train.jsonl"] and spark.read.json(f"{at}/x.jsonl").count() == 3
    sinks.documents_by_split(docs(("1", "a/b")), at, "x")
    sinks.documents_by_split(docs(("1", "test")), at, "xy")
    assert put() == ["x_a%2Fb.jsonl", "xy_test.jsonl"]  # a split's name is no path


def test_a_missing_corpus(spark, put, tmp_path):
    with pytest.raises(FileNotFoundError):
        drivers.known_corpora(spark, str(tmp_path), ["cdr"])
    (tmp_path / "NCBI").mkdir()
    with pytest.raises(FileNotFoundError):
        drivers.known_corpora(spark, str(tmp_path), ["ncbi"])[0].read(spark)


def test_labels_of_several_parts(spark, put, tmp_path):
    put_all(put)
    at = str(tmp_path / "ADR_cleaned/train")
    assert {r.doc_id for r in corpora.labels(spark, at, "train").collect()} == {"X", "Y"}
    assert {r.doc_id for r in corpora.labels(spark, at, "train", drop_documents=True).collect()} == {"X"}


def test_crosswalk_takes_english_atoms_of_allowed_sources(spark, release):
    atoms, _ = release
    got = {(r.cui, r.sab) for r in concepts.crosswalk(atoms, atoms).collect()}
    assert got == {("C0000001", "MSH"), ("C0000001", "OMIM"), ("C0000002", "SNOMEDCT_US"), ("C0000002", "MDR"), ("C0000003", "GO")}
    assert {(r.cui, r.sab) for r in concepts.crosswalk(atoms, atoms, None).collect()} == got | {("C0000003", "SCTSPA")}
