"""Folds, containment and paths against plain models on random small inputs."""

import random

from pyspark.sql import functions as F

from conceptloom.functions import codes, text
from conceptloom import session
from conceptloom.operators import concepts, datasets, hierarchy
from conceptloom.streaming.incremental import link_stream

ATOMS = "cui string, lat string, ispref string, sab string, tty string, code string, str string, line_no long"


def random_atoms(seed, n=120):
    r = random.Random(seed)
    return [(f"C{r.randrange(9):07d}", r.choice(["ENG", "ENG", "FRE"]), r.choice("YN"), r.choice(["MSH", "GO"]), r.choice(["PT", "SY", "PN"]), f"D{r.randrange(30)}", r.choice(["cold", "Cold sore", "cold arm", "fever", "feverish child", "f"]), k) for k in range(n)]


def test_name_fold(spark, frame):
    rows = random_atoms(1)
    model = {}
    for cui, lat, pref, _, tty, _, name, _ in rows:
        if lat != "ENG":
            continue
        key, new = name.lower(), (cui, pref == "Y", tty in concepts.PREFERRED)
        now = model.get(key)
        if now is None or (not now[1] and new[1]) or (not now[2] and new[2]):
            model[key] = new
    assert {r.name: r.cui for r in concepts.name_index(frame(rows, ATOMS)).collect()} == {k: v[0] for k, v in model.items()}


def test_containment(spark, frame):
    rows = random_atoms(2, 40)
    norm = lambda s: "".join(c for c in s.lower().strip() if c.isalnum())
    toks = lambda s: {t for t in __import__("re").split("[^a-z0-9]+", s.lower()) if len(t) >= 3}
    first = {}
    for r in rows:
        if r[1] == "ENG":
            first.setdefault(norm(r[6]), r)
    texts = ["cold", "COLD sores", "fe", "x", "feverish", "", "é cold", "z cold", "ol", "o", "ever", "f", "the cold fever of"]
    expected = {}
    for t in texts:
        n = norm(t)
        bucket = any(k[:1] == n[:1] for k in first)
        found = [(-len(toks(t) & toks(r[6])), abs(len(k) - len(n)), bucket and len(n) > 1 and k[:2] != n[:2], r[7], r[0]) for k, r in first.items() if n and k and (not bucket or k[0] == n[0]) and (n in k or k in n)]
        if found:
            expected[t] = min(found)[4]
    got = concepts.link_contained(frame([(t, t) for t in texts], "id string, text string"), frame(rows, ATOMS)).collect()
    assert {r.id: r.cui for r in got} == expected and "z cold" in expected


def test_cleaners_and_formats(spark, frame):
    one = lambda f, t: frame([(t,)], "t string").select(f(F.col("t")).alias("c")).first().c
    assert one(text.clean_label, "a  b . \n\n\n( c )  \nd ") == "a b.\n(c)\nd "
    assert one(text.clean_note, " Mr ___ on __ at  5 : x - y / z\n \n\n\n ok ( a ) ____b_") == "Mr on at 5: x - y/z\n\nok (a) b_"
    assert one(text.clean_report, "00||||x\nA  b \n\n c [** d **] ____ ( e ) !") == "A b\n c [** d **] ___ (e)!"
    rows = [("LNC", c) for c in ("2339-0", "233-0", "MTHU013518", "MTHU1", "LP7484-8", "12345")] + [("LCH_NW", c) for c in ("fst00123456", "sj1", "abc!")]
    rows += [("ICD10CM", c) for c in ("U07.1", "A00A", "A00-B99", "C4A", "S06X", "E1234.1", "12")] + [("ICD9CM", c) for c in ("30", "31", "001-139", "001-139.99", "V12.3", "49.46")]
    ok = [r.code for r in frame(rows, "v string, code string").where(codes.valid(F.col("v"), F.col("code"))).collect()]
    assert sorted(ok) == sorted(["2339-0", "MTHU013518", "LP7484-8", "fst00123456", "U07.1", "A00A", "A00-B99", "C4A", "S06X", "E1234.1", "30", "001-139", "V12.3"])
    assert one(codes.meddra_id, "10012345") == "10012345" and one(codes.meddra_id, "123") == ""


def test_offset_map(spark, frame):
    before, after = "a  ( b ) ___ c", "a (b) c"
    at = frame([(before, after), (None, "x")], "a string, b string").select(text.offset_map(F.col("a"), F.col("b")).alias("m")).collect()
    maps = next(r.m for r in at if r.m is not None)
    assert len(maps) == len(before) and after[maps[before.index("b")]] == "b" and maps[0] == 0 and any(r.m is None for r in at)


def test_native_tries_in_order(spark, frame):
    atoms = frame([("C0000001", "ENG", "Y", "SNOMEDCT_US", "PT", "12345", "heart attack", 1), ("C0000002", "ENG", "Y", "MDR", "PT", "10001", "old pain", 2), ("C0000003", "FRE", "N", "MSH", "PT", "D777", "douleur", 3), ("C0000004", "ENG", "N", "SCTSPA", "PT", "12345", "later", 4)], ATOMS)
    types = frame([("C0000001", "T047", 0), ("C0000003", "T184", 0)], "cui string, tui string, pos int")
    link = lambda rows, schema, spec: {r.k: (r.linked, r.method) for r in datasets.link(frame(rows, schema), atoms, types, datasets.SPECS[spec]).collect()}
    got = link([(0, "0012345.7", "x", ""), (1, "CONCEPT-LESS", "010001", ""), (2, "", "", "HEART attack "), (3, "", "", "Douleur"), (4, "99", "", "nothing else"), (5, None, None, None), (6, "", "", "pain")], "k int, snomed_id string, meddra_id string, text string", "cadec")
    assert got == {0: ("C0000001", "native_id_mapping"), 1: ("C0000002", "native_id_mapping"), 2: ("C0000001", "exact_match"), 3: ("C0000003", "exact_match"), 4: ("", "no_mapping"), 5: ("", "no_mapping"), 6: ("C0000002", "semantic_containment")}
    rows = [(0, "C0000002", None, [("OMIM", "5"), ("MSH", "777")], "q"), (1, "C0000001", None, [("MSH", "D777")], "q"), (2, "", "MSH", [], "q")]
    got = link([(k, c, "D777", o, x, t) for k, c, o, x, t in rows], "k int, concept_id string, native_id string, native_ontology_name string, candidates array<struct<sab:string,code:string>>, text string", "ncbi")
    assert got == {0: ("C0000003", "native_id_mapping"), 1: ("C0000001", "native_id_mapping"), 2: ("C0000003", "native_id_mapping")}
    retyped = datasets.link(frame([("C0000001", "T000", "x"), ("C0000009", "T000", "old pain")], "cui string, semantic_type string, text string"), atoms, types, datasets.SPECS["medmentions"]).collect()
    assert {(r.linked, r.semantic_type) for r in retyped} == {("C0000001", "T047"), ("C0000002", "T000")}
    umls = datasets.link(frame([("C0000002", "UMLS", ""), ("C0000008", "UMLS", "")], "native_id string, native_ontology_name string, text string"), atoms, types, datasets.SPECS["cdr"]).collect()
    assert {(r.native_id, r.linked) for r in umls} == {("C0000002", "C0000002"), ("C0000008", "")}


def test_paths_equal_plain_search(spark, frame):
    r = random.Random(3)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(14))})
    up = {}
    for a, b in edges:
        up.setdefault(a, []).append(b)

    def walk(node, path):
        if node not in up:
            return [path]
        return [p for b in up[node] if b not in path for p in walk(b, [b, *path])]

    starts = sorted({x for e in edges for x in e})
    expected = sorted((s, tuple(p)) for s in starts for p in walk(s, [s]))
    got = hierarchy.walk_up(frame([(s,) for s in starts], "code string"), frame(edges, "child string, parent string")).collect()
    assert sorted((x.code, tuple(x.path)) for x in got) == expected


def test_caps_and_deep_chain(spark, frame):
    paths = frame([("a", ["r", "x", "a"]), ("a", ["r", "a"]), ("a", ["r", "b", "c", "a"])], "code string, path array<string>")
    assert [r.path for r in hierarchy.capped(paths, 5, 3).orderBy(F.size("path")).collect()] == [["r", "a"], ["r", "x", "a"]]
    assert sorted(len(r.path) for r in hierarchy.capped(paths, 5, 3, truncate=True).collect()) == [2, 3, 3]


def test_code_functions(spark, frame):
    rows = frame([("MSH", "D012"), ("SNOMEDCT_US", "00123"), ("MDR", "0077"), ("MSH", "12")], "sab string, code string")
    got = {(r.sab, r.code): [x.code for x in r.k] for r in rows.select("sab", "code", codes.ladder(F.col("sab"), F.col("code")).alias("k")).collect()}
    assert got == {("MSH", "D012"): ["D012", "012"], ("SNOMEDCT_US", "00123"): ["00123", "123"], ("MDR", "0077"): ["0077", "77"], ("MSH", "12"): ["12", "D12"]}
    forms = frame([("123.0",), ("A01.2",), ("-1",)], "c string").select(codes.cleaned(F.col("c")).alias("a"), codes.cleaned(F.col("c"), cut_at_dot=True).alias("b")).collect()
    assert [tuple(r) for r in forms] == [("123", "123"), ("A01.2", "A01"), (None, None)]


def test_offsets_after_cleaning(spark, frame):
    rows = frame([("a  ( x ) , pain", 10, "pain")], "t string, at int, m string")
    clean = text.clean_label(F.col("t"))
    got = rows.select(clean.alias("c"), text.relocated(clean, F.col("m"), text.moved_offset(F.col("t"), F.col("at"), text.clean_label)).alias("s")).first()
    assert got.c[got.s : got.s + 4] == "pain"


def test_closest_synonym_makes_no_row_of_a_pair(spark, frame):
    """Of 2,500 names a concept's best by a plain search; pairs are aggregated unsorted, in the stage that makes them."""
    r, pick = random.Random(3), ["cold", "sore", "arm", "pain", "x", "Fever "]
    names = [(f"C{k % 2}", " ".join(r.choices(pick, k=r.randrange(1, 5))), k) for k in range(5000)] + [("C0", None, 9000), ("C2", "only", 1)]
    asked = [(k, f"C{k % 3}", " ".join(r.choices([*pick, "COLD", "rash"], k=r.randrange(1, 4)))) for k in range(300)] + [(900, "C0", None), (901, "C9", "cold")]
    held, wanted = frame(names, "cui string, str string, line_no long"), frame(asked, "id long, cui string, text string")
    words = lambda t: {w for w in t.lower().split() if len(w) > 2}
    fold = lambda t: t.strip().lower()
    plain = {}
    for i, cui, t in asked:
        own = [(0, 0, 0, n, s) if t is None else (fold(s) != fold(t), -len(words(s) & words(t)), abs(len(s) - len(t)), n, s) for c, s, n in names if c == cui and s is not None]
        if own:
            plain[i] = min(own)[4]
    got = concepts.closest_synonym(wanted, held)
    assert {x.id: x.name for x in got.collect()} == plain
    near = concepts.nearest_classes(*[concepts._shaped(d, c) for d, c in ((wanted, "text"), (held, "str"))])
    plan = near._jdf.queryExecution().sparkPlan().toString().split("\n")
    best = next(k for k, x in enumerate(plan) if "partial_max" in x)
    assert "HashAggregate" in plan[best] and not any("SortAggregate" in x for x in plan[:best])


def test_stream_links_batches(spark, frame, tmp_path, monkeypatch):
    atoms = frame([("C0000001", "ENG", "Y", "MSH", "PT", "D100", "cold", 0)], ATOMS)
    source = str(tmp_path / "in")
    spark.createDataFrame([("MSH", "D100", ""), ("MSH", "", "COLD"), ("MSH", "", "zzz")], "sab string, code string, text string").write.parquet(source)
    spark.createDataFrame([("MSH", "", "a cold")], "sab string, code string, text string").write.mode("append").parquet(source)
    stream = spark.readStream.schema("sab string, code string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    number = iter(range(1000))
    monkeypatch.setattr(session, "shared_path", lambda spark, tag: f"file://{tmp_path}/shared/{tag}-{next(number)}")
    index = concepts.Indexes(atoms).ready()
    kept = sorted(p.name for p in (tmp_path / "shared").iterdir())
    link_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(kept) == 4 and sorted(p.name for p in (tmp_path / "shared").iterdir()) == kept  # the indexes alone stay
    assert sorted(r.method for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["exact_match", "native_id_mapping", "no_mapping", "semantic_containment"]
