"""Jaccard join, substring deduplication and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conceptloom.llm import decontamination, jaccard_join, substring_dedup
from conceptloom.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(seed=5, families=8):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 9, 11, 14, 25, 40, 90, 300]))]
        for _ in range(7):
            words = list(base)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(1, 3)
            out.append(" ".join(words))
    return out + out[:5] + [out[0].upper(), "", None, "one", "ONE", "two words", "a\x1cb", " \t\n"]


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_components(documents, percent, size):
    texts = near_copies()
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))
    links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = jaccard_join.jaccard_components(documents(texts), percent, size).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, len(sets[i]), root[i], links[i]) for i in range(len(texts))}
    assert any(links.values())


def test_every_linking_pair_shares_a_signature():
    r = np.random.default_rng(1)
    for percent in (80, 90):
        scheme = jaccard_join.Scheme(percent)
        for _ in range(600):
            n = int(r.integers(1, 400))
            base = r.integers(0, 1 << 63, n).astype(np.uint64)
            most = scheme.most_differing(n)
            drop, add = (int(r.integers(0, most + 1)) for _ in range(2))
            other = np.unique(np.concatenate([r.permutation(base)[: n - min(drop, n - 1)], r.integers(0, 1 << 63, add).astype(np.uint64)]))
            a, b = np.unique(base), other
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b))), (n, len(b))


def test_sketches_bound_what_sets_have_in_common():
    r = np.random.default_rng(4)
    for _ in range(60):
        base = r.integers(0, 1 << 63, int(r.integers(1, 900))).astype(np.uint64)
        sets = [np.unique(np.concatenate([r.permutation(base)[: int(r.integers(1, len(base) + 1))], r.integers(0, 1 << 63, int(r.integers(0, 60))).astype(np.uint64)])) for _ in range(6)]
        n = np.array([len(x) for x in sets])
        both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
        told = [jaccard_join.sketch(x) if k else b"" for k, x in enumerate(sets)]
        most = jaccard_join.most_common(told, n)
        assert (most >= both).all() and (np.diag(most) == n).all()


def test_blocks_of_a_family(documents, monkeypatch):
    texts = near_copies(7)
    whole = {(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(documents(texts)).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 2)
    assert {(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(documents(texts)).collect()} == whole


def test_groups_are_not_chained(frame):
    """Each text shares half its words with the next: none links, and no group may grow with their number."""
    r = random.Random(11)
    parts = [[f"w{r.randrange(10**9)}" for _ in range(60)] for _ in range(61)]
    texts = [" ".join(parts[k] + parts[k + 1]) for k in range(60)]
    rows = frame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    known = jaccard_join.IdFilter(rows, "id")
    groups = Counter(x.family for x in jaccard_join.shared_groups(rows, known, 80, 5).collect())
    assert groups and max(groups.values()) <= 3


@pytest.mark.parametrize("sides", [1, 2])
def test_possible_groups(sides):
    r = np.random.default_rng(3)
    bases = [r.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(9)]
    sets = [np.unique(np.concatenate([bases[int(r.integers(0, 9)) // (1 + k % 3)][: int(r.integers(150, 201))], r.integers(0, 1 << 63, int(r.integers(0, 40))).astype(np.uint64)])) for k in range(90)]
    n, side = np.array([len(x) for x in sets]), r.integers(0, sides, 90)
    told = [jaccard_join.sketch(x) if k % 10 else b"" for k, x in enumerate(sets)]
    both = jaccard_join.most_common(told, n)
    hit = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    hit &= side[:, None] != side[None, :] if sides > 1 else ~np.eye(90, dtype=bool)
    want = jaccard_join.spanning(hit)
    for most in (1, 7, 90, 256):
        assert np.array_equal(jaccard_join.possible_groups(told, n, side, 80, most), want)


def test_keep_one(frame):
    schema = "doc_id long, text string, _a string, keep string, n int, `k1` long, id string"
    rows = [
        (0, "a b c d e f", "x", "k", 1, 2, "i"),
        (1, "A b c d e f", "x", "k", 1, 2, "i"),
        (0, "a b c d e f", "other columns", None, 1, 2, "i"),
        (2, "", "x", "k", 1, 2, "i"),
        (2, "", "x", "k", 1, 2, "i"),
        (3, None, "x", "k", 1, 2, "i"),
        (None, "x y z", "x", "k", 1, 2, "i"),
        (None, "quite another text", "x", "k", 1, 2, "i"),
        (7, "this is one text", "x", "k", 1, 2, "i"),
        (7, "and here is a second", "x", "k", 1, 2, "i"),
        (None, "copies of a row", "x", "k", 1, 2, "i"),
        (None, "copies of a row", "x", "k", 1, 2, "i"),
        (9, "copies of a row", "x", "k", 1, 2, "i"),
        (8, "twice as it is", "x", "k", 1, 2, "i"),
        (8, "twice as it is", "x", "k", 1, 2, "i"),
    ]
    docs = frame(rows, schema)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect() if r.text) == [(-1, "quite another text"), (-1, "x y z"), (0, "a b c d e f"), (7, "and here is a second"), (7, "this is one text"), (8, "twice as it is"), (9, "copies of a row")]
    assert sum(not r.text for r in kept.collect()) == 3
    assert jaccard_join.keep_one(docs.limit(0)).isEmpty()


def test_rows_that_share_an_id(frame):
    docs = frame([(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (None, "e f g h"), (None, "i j k"), (None, "i j k"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.n_links) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == [(0, 1, 0, 1), (0, 1, 0, 1), (0, 2, 1, 1), (1, 2, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (3, 0, 3, 0)]


def brute_cut(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for w in words:
        cover = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                cover[k : k + size] = [True] * size
        out.append((len(w), sum(cover), hashlib.sha256(" ".join(x for x, c in zip(w, cover) if not c).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_passages(spark, documents, batches):
    r = random.Random(9)
    word = lambda: f"v{r.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(r.randrange(0, 80))]
        for p in r.sample(passages, r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = p
        texts.append(" ".join(w))
    texts += [texts[3], "same " * 90, "é\x1c " * 40, "", None, "\t".join(passages[3]), "again " + " ".join(passages[2] * 2)]
    index = substring_dedup.FingerprintIndex(spark, max_runs=2)
    got = substring_dedup.remove_repeats(documents(texts), index, batches=batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(brute_cut(texts, 35)))
    assert len(index.runs) <= 2


def test_incremental_batches_find_the_past(spark, documents):
    passage = " ".join(f"p{k}" for k in range(50))
    index = substring_dedup.FingerprintIndex(spark)
    assert index.ingest(documents([passage])).isEmpty()
    hits = index.ingest(documents([f"new {passage} end", "nothing else here"]))
    assert 0 < hits.count() <= index.fingerprints().where("n > 1").count()
    before = index.fingerprints().count()
    index.compact()
    assert len(index.runs) == 1 and index.fingerprints().count() == before


def test_repeats_across_calls(spark, documents):
    passage, other = (" ".join(f"{x}{k}" for k in range(50)) for x in "po")
    index = substring_dedup.FingerprintIndex(spark)
    first = substring_dedup.remove_repeats(documents([f"head {passage} tail", "short text", None]), index, remember=True).collect()
    assert all(r.n_removed == 0 for r in first)
    texts = [f"new {passage} end", f"only here {other}", "", " ".join(passage.split()[:34])]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(documents(texts), index, remember=True).collect()}
    assert got == {0: 50, 1: 0, 2: 0, 3: 0}
    assert [r.n_removed for r in substring_dedup.remove_repeats(documents([f"x {other}"]), index).collect()] == [50]


def test_null_ids_and_very_long_texts_keep_their_words(frame):
    long = " ".join(f"w{k}" for k in range(60_000))
    passage = " ".join(f"w{k}" for k in range(30_000, 30_050))
    docs = frame([(None, long, "x"), (None, f"a {passage} b", "y"), (5, passage, "z"), (5, "another text", "z")], "doc_id long, text string, key string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 52, 50), (0, 60_000, 50), (5, 2, 0), (5, 50, 50)]


def test_long_run_of_equal_windows(documents):
    texts = [" ".join(f"p{k}" for k in range(40))] * 300
    got = substring_dedup.remove_repeats(documents(texts)).collect()
    assert len(got) == 300 and all(r.n_removed == 40 for r in got)


def test_leaks(frame, documents):
    r = random.Random(4)
    word = lambda: f"t{r.randrange(900)}"
    items = [[word() for _ in range(n)] for n in (12, 20, 33, 50, 64, 90)]
    texts, planted = [], set()
    for k in range(60):
        w = [word() for _ in range(r.randrange(5, 300))]
        if k % 3 == 0:
            item = r.randrange(len(items))
            own = list(items[item])
            if k % 2:
                own[len(own) // 3] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = own
            planted.add((k, item))
        texts.append(" ".join(w))
    bench = frame([(k, " ".join(x).upper() + ".") for k, x in enumerate(items)] + [(97, None), (98, "")], "item_id long, text string")
    docs = documents([*texts, "", None])
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
    assert got == planted
    kept = {x.doc_id for x in decontamination.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(62)) - {d for d, _ in planted}
    assert decontamination.leaks(docs, bench.where("item_id > 96")).isEmpty()


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_subsequences():
    r = random.Random(2)
    for longest in (20, 64, 65, 200):
        for _ in range(25):
            size = r.choice([3, 6, 40])
            pattern, text = ([r.randrange(size) for _ in range(r.randrange(1, longest))] for _ in range(2))
            cuts = [sorted(r.choices(range(len(text) + 1), k=2)) for _ in range(5)]
            got = decontamination.common_subsequences(np.array(pattern), np.array(text), *(np.array(x) for x in zip(*cuts, strict=True)), size + 1)
            assert got.tolist() == [subsequence(pattern, text[a:b]) for a, b in cuts]


def test_leaks_against_brute_force(spark, sf, corpus):
    """Every region of every text is compared with every item; the cosine takes no match away."""
    import pyarrow.parquet as pq

    step, bench = decontamination.STEP, pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    bare = lambda t: [x for x in decontamination._describe((t or "").encode().split())["h"].tolist()]
    wanted = set()
    texts = [(d, bare(t)) for d, t in zip(corpus.doc_id, corpus.text, strict=True)]
    for b in bench:
        item = bare(b["text"])
        length = decontamination.window_length(len(item))
        stride, margin = max(1, length // 3), length // 2 + 1
        for d, words in texts:
            blocks = -(-len(words) // step)
            for k in range(-(-max(blocks - length, 0) // stride) + 1):
                start = min(k * stride, max(blocks - length, 0))
                region = words[max(start - margin, 0) * step : (min(start + length, blocks) + margin) * step]
                if len(set(item) & set(region)) < 0.3 * len(set(item)):
                    continue
                share = subsequence(item, region) / len(item)
                answer = item[-decontamination.ANSWER_WORDS :]
                if share >= decontamination.VERBATIM or share >= decontamination.PARAPHRASE and subsequence(answer, region) >= decontamination.ANSWER * len(answer):
                    wanted.add((int(d), b["item_id"]))
    docs, items = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, items).collect()} == wanted and wanted


def test_recall_of_planted_paraphrases(spark, sf, frame, corpus):
    """Items with up to three words in ten changed, put anywhere into other texts; at least nine in ten are found."""
    import pyarrow.parquet as pq

    r, bench = random.Random(11), pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    texts = [t for t in corpus.text if t and len(t.split()) > 30]
    vocabulary = sorted({w for t in texts[:50] for w in t.split()})
    rows, planted = [], set()
    for k in range(200):
        item = r.choice(bench)
        own = item["text"].split()
        for at in r.sample(range(max(1, len(own) - decontamination.ANSWER_WORDS)), int(len(own) * r.choice([0.1, 0.2, 0.3]))):
            own[at] = r.choice(vocabulary)
        words = texts[k % len(texts)].split()[:2000]
        at = r.randrange(len(words))
        rows.append((k, " ".join(words[:at] + own + words[at:])))
        planted.add((k, item["item_id"]))
    found = {(x.doc_id, x.item_id) for x in decontamination.leaks(frame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(found & planted) >= 0.9 * len(planted)


def test_the_latent_space_is_of_all_documents_and_items(frame):
    """Counts and the space equal those of plain matrices over 900 texts and an item; topics lie apart."""
    r, d = np.random.default_rng(4), decontamination
    texts = [" ".join(f"t{k % 3}w{j}" for j in r.integers(0, 30, 40)) for k in range(900)] + ["", None]
    bench = frame([(1, " ".join(f"t1w{j}" for j in range(12)))], "item_id long, text string")
    got = d.statistics(frame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), bench)
    rows = np.zeros((902, d.TERMS))
    for k, t in enumerate([*texts[:901], " ".join(f"t1w{j}" for j in range(12))]):
        own = np.unique(d._describe(t.encode().split())["term"])
        rows[k, own] = 1
    assert got.documents == 902 and got.df.tolist() == rows[:901].sum(axis=0).tolist() and abs(got.rates.sum() - 1) < 1e-9
    rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    assert np.allclose(got.product, rows.T @ (rows @ d._random_terms()), atol=1e-2)
    idf = np.log((1 + got.documents) / (1 + got.df)) + 0.1
    space = d.latent(got.product, idf)
    topic = [(space[d._describe([f"t{k}w{j}".encode() for j in range(30)])["term"]] * 1.0).sum(axis=0) for k in range(3)]
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert max(abs(cosine(topic[a], topic[b])) for a, b in ((0, 1), (0, 2), (1, 2))) < 0.5
    exact = np.linalg.svd(rows * idf, full_matrices=False)[2][:3]
    assert np.linalg.norm(space.T @ exact.T, axis=0).min() > 0.98


def test_leaks_of_repeated_rows_long_texts_and_named_items(frame):
    item = " ".join(f"q{k}" for k in range(30))
    long = "filler " * 120_000 + item + " filler" * 100
    docs = frame([(1, item, "x"), (1, item, "x"), (None, item, "y"), (2, long, "z"), (3, "", "z"), (4, None, "z")], "doc_id long, text string, item_id string")
    bench = frame([("first", item, 1), ("first", item, 1), (None, "other words " * 9, 2), ("empty", "", 3)], "item_id string, text string, doc_id long")
    got = sorted((x.doc_id or 0, x.item_id) for x in decontamination.leaks(docs, bench).collect())
    assert got == [(0, "first"), (1, "first"), (1, "first"), (2, "first")]
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [3, 4]


def test_empty_tables(documents, frame):
    none = documents([]).limit(0)
    assert jaccard_join.jaccard_components(none).isEmpty()
    assert substring_dedup.remove_repeats(none).isEmpty()
    bench = frame([(1, "a b c")], "item_id long, text string")
    assert decontamination.leaks(none, bench).isEmpty()


def test_words_cache_is_bounded():
    table = Words(lambda new: {"n": np.array([len(w) for w in new])}, most=10)
    for k in range(5):
        ids, ends = table.indices([[b"a" * j for j in range(1, 9)], [], [b"x%d" % k]])
        assert table.columns["n"][ids].tolist() == [*range(1, 9), 2] and ends.tolist() == [0, 8, 8, 9]
    assert len(table) <= 19


def test_a_leak_beside_heavy_words_is_found():
    r = np.random.default_rng(2)
    item = " ".join(f"q{k}" for k in range(40))
    idf = np.ones(decontamination.TERMS)
    weights = 0.01 * r.standard_normal((decontamination.TERMS, 8)).astype(np.float32)
    heavy = decontamination._describe([b"heavy"])["term"][0]
    weights[heavy] = 100.0
    queries = decontamination.prepare_queries([(7, item, None)], weights, idf)
    for changed, kind in ((0, 1.0), (12, 0.7)):  # verbatim, and with words changed but the answer kept
        words = [f"z{k}" if k < changed else w for k, w in enumerate(item.split())]
        text = " ".join(["heavy"] * 30 + words + ["heavy"] * 30)
        found = decontamination.find(queries, queries.table(), [text.encode(), ("heavy other " * 50).encode(), b""])
        assert [(x[0], x[1]) for x in found] == [(0, 0)] and found[0][2] == pytest.approx(kind) and found[0][3] >= decontamination.COSINE


def test_words_that_no_item_has_are_not_hashed(monkeypatch):
    """Hashing every new word of a corpus, and comparing regions that lack an item's words, took most of the time of this step."""
    item = " ".join(f"w{k}" for k in range(40)) + " w1 -- w2"
    weights = np.ones((decontamination.TERMS, 4), np.float32)
    queries = decontamination.prepare_queries([(1, item, None)], weights, np.ones(decontamination.TERMS))
    hashed, compared, hashes, common = [], [], decontamination.word_hashes, decontamination.common_subsequences
    monkeypatch.setattr(decontamination, "word_hashes", lambda words: hashed.extend(words) or hashes(words))
    monkeypatch.setattr(decontamination, "common_subsequences", lambda pattern, codes, low, *more: compared.extend(low) or common(pattern, codes, low, *more))
    other = [f"x{k}, y{k} {k}." for k in range(3000)]
    copied = " ".join([*other[:9], item.upper().replace("W5 ", "(W5), "), *other[9:]])
    few = " ".join(["w1 w2 w1 w2"] * 100)  # enough of the rarest words, but few of the item's
    found = decontamination.find(queries, queries.table(), [copied.encode(), " ".join(other).encode(), few.encode()])
    assert [(r, k, share) for r, k, share, _ in found] == [(0, 0, 1.0)]
    assert len(hashed) < 300 and len(compared) < 20
