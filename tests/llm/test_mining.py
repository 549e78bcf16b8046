"""Near duplicates by odd sketches, hard negatives and collocations against brute force, and their edge cases."""

import random
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from test_pairs_and_passages import near_copies, shingles

from conceptloom.llm import collocations, hard_negatives, odd_sketches
from pyspark.sql import functions as F


def components(sets, percent):
    root, links = list(range(len(sets))), Counter()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root, links


@pytest.mark.parametrize("percent,size", [(85, 3), (80, 5)])
def test_near_duplicates(documents, percent, size):
    texts = [*near_copies(3), " ".join(f"x{k}" for k in range(30_000)), " ".join(f"x{k}" for k in range(29_000))]
    sets = [shingles(t, size) for t in texts]
    root, links = components(sets, percent)
    got = odd_sketches.near_duplicates(documents(texts), percent, size).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links, r.kept) for r in got} == {(i, len(sets[i]), root[i], links[i], root[i] == i) for i in range(len(texts))}
    assert any(links.values())


def test_near_duplicates_without_ids(frame):
    schema = "doc_id long, text string, sketch string, n int, kept string"
    docs = frame([(1, "a b c d", "x", 1, "k"), (1, "A b c d", "x", 1, "k"), (None, "a b c d", "x", 1, "k"), (None, "e f", "x", 1, "k"), (None, "e f", "x", 1, "k"), (2, None, "x", 1, "k"), (2, " ", "x", 1, "k")], schema)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.n_links, r.kept) for r in odd_sketches.near_duplicates(docs).collect())
    assert got == [(0, 1, 0, 1, True), (0, 1, 0, 1, True), (0, 2, 1, 2, False), (1, 2, 1, 2, True), (1, 2, 1, 2, True), (2, 0, 2, 0, True), (2, 0, 2, 0, True)]
    assert odd_sketches.near_duplicates(docs.limit(0)).isEmpty()


def test_sketches_tell_similarity():
    """The estimate is near the truth where similarity is high, and no pair at the threshold fails either test."""
    r = np.random.default_rng(2)
    samples = odd_sketches.bands_for(85) * odd_sketches.ROWS
    most = odd_sketches.most_apart(85, samples)
    errors, ruled_out = [], 0
    for k in range(300):
        n = int(r.integers(20, 900))
        base = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        share = (0.85, 0.95, 0.4)[k % 3]
        both = round(n * share * 2 / (1 + share))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:both], base[n : 2 * n - both]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = odd_sketches.minima([a, b], samples)
        apart = odd_sketches.differing(odd_sketches.odd_sketch(found).view(np.uint64))[0, 1]
        if true >= 0.85:
            assert apart <= most and np.intersect1d(*odd_sketches.banded(found)).size
        if true > 0.8:
            errors.append(abs(odd_sketches.similarity(apart, samples) - true))
        elif true < 0.45:
            ruled_out += apart > most
    assert np.mean(errors) < 0.03 and ruled_out == 100


def mined(rows, positives=5, negatives=10, low=30, high=90, every=100):
    """rows: (id, vector or None, label); the plain definition. Copies are rows of their own."""
    told = []
    for k, (i, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        told.append((k, i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    last = float("inf")
    out = []
    for k, i, label, v in told:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), last if j is None else j, c, n) for c, j, n, w in told if c != k)
        for p, pid, _, _ in [x for x in scored if x[3] == label][:positives]:
            band = [x for x in scored if x[3] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(i, pid, at + 1, nid, -p, -s) for at, (s, nid, _, _) in enumerate(band)]
    return sorted(out)


def found_in(df):
    return sorted(tuple(float("inf") if x is None else x for x in r) for r in df.collect())


def test_hard_negatives(frame, monkeypatch):
    r = random.Random(11)
    centres = [[r.gauss(0, 0.2) for _ in range(8)] for _ in range(4)]
    rows = [(k, [c + r.gauss(0, 0.15) for c in centres[k % 4]], k % 3) for k in range(600)]
    rows += [(700, None, 1), (701, [0.1] * 8, None), (702, [0.1, float("nan")] * 4, 1), (703, [float("inf")] * 8, 1), (704, [None] + [0.1] * 7, 2), (None, [0.2] * 8, 1), (800, [0.3] * 5, 2), (900, [], 0)]
    rows += rows[100:103] + [(5, [0.2] * 8, 1)] * 3 + [(6, [0.2] * 8, 0)] * 15
    docs = frame([(*x, "extra", 1) for x in rows], "vec_id long, embedding array<float>, label int, row string, x int")
    expected = mined(rows)
    assert len(expected) > 100
    for block, size in ((8192, 512), (3, 16)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "ROWS", size)
        assert found_in(hard_negatives.hard_negatives(docs, F.col("vec_id") % 100 == 0)) == expected
    assert hard_negatives.hard_negatives(docs.limit(0), F.col("vec_id") % 100 == 0).isEmpty()
    assert hard_negatives.hard_negatives(docs.where("vec_id % 100 <> 0"), F.col("vec_id") % 100 == 0).isEmpty()


def test_scores_beyond_exact_doubles(frame):
    rows = [(k, [float(np.float32((k * 7919) % 1000 * 300.0 + 1 / 256)), 5.0e5 + k], k % 2) for k in range(12)]
    docs = frame(rows, "vec_id long, embedding array<float>, label int")
    assert found_in(hard_negatives.hard_negatives(docs, F.col("vec_id") == 0)) == mined(rows)
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(frame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0)


def test_brackets_hold_scores_and_rule_rows_out():
    r = np.random.default_rng(8)
    import pyarrow as pa

    x = r.integers(-60, 60, (2000, 6)) + 200 * r.integers(-1, 2, (2000, 1))
    pivots = hard_negatives.Pivots([v.tolist() for v in x[:300]], int((x * x).sum(axis=1).max()), 6)
    anchors = pa.table({"row": range(40), "label": [0] * 40, "id": range(40), "v": [v.astype("<i4").tobytes() for v in x[:40]]})
    block = hard_negatives.Block(anchors, pivots)
    d, score = pivots.distances(x.astype(float)), x[:40] @ x.T
    least = np.sort(score, axis=1)[:, -20].astype(float)
    some, mask = block.survivors(d, np.arange(40), least, np.full(40, np.inf))
    assert (some == np.arange(40)).all() and mask[score >= least[:, None]].all()
    assert mask.mean() < 0.5


def phrases(rows, least=10, most_words=3, covered=50, top=2000):
    """rows: (text, lang); the plain definition."""
    f, n = Counter(), Counter()
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for text, lang in rows:
        lang = lang or "und"
        marks = [" " if c == "\t" else None if c in ".,;:!?\n\x0b\x0c\r" else c for c in (text or "").translate(low)]
        for whole, piece in groupby(marks, lambda c: c is not None):
            w = [x for x in "".join(piece).split(" ") if x] if whole else []
            n[lang] += len(w)
            f.update((lang, *w[a : a + z]) for z in range(1, most_words + 1) for a in range(len(w) - z + 1))
    out = []
    for p, a in f.items():
        lang, w = p[0], p[1:]
        if len(w) < 2 or a < least:
            continue
        longer = [b for q, b in f.items() if b >= least and q[0] == lang and len(q) - 1 > len(w) and any(q[1 + k : 1 + k + len(w)] == w for k in range(len(q) - len(w)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r, n[lang]))
    return sorted((lang, rank + 1, w.decode(), -a, l, r, n_, -s) for _, g in groupby(sorted(out), lambda x: x[0]) for rank, (lang, s, a, w, l, r, n_) in enumerate(list(g)[:top]))


@pytest.mark.parametrize("most_words,top", [(3, 2000), (4, 7), (2, 2000)])
def test_collocations(frame, monkeypatch, most_words, top):
    r = random.Random(5)
    words = ["ab", "Ab", "c", "Él", "x\x1cy", "d e", "f", "g", "straße", "ÉL", "h"]
    breaks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]
    texts = ["".join(r.choice(words) + r.choice(breaks) for _ in range(r.choice([0, 1, 5, 60, 400]))) for _ in range(60)]
    texts += ["the quick fox. " * 40, "a a a a a " * 9, "new york city " * 12, "new york " * 3, "", None, " \t\n", ".", "the quick fox. " * 40]
    rows = [(t, ("en", "de", None)[k % 3]) for k, t in enumerate(texts)] + [("word " * 50_000, "en")]
    docs = frame([(t, l, "x", 1) for t, l in rows], "text string, lang string, phrase string, f int")
    expected = phrases(rows, 5, most_words, 50, top)
    assert len(expected) > 15
    for group in (1 << 18, 4):
        monkeypatch.setattr(collocations, "GROUP_BYTES", group)
        monkeypatch.setattr(collocations, "RANKED_ROWS", group)
        assert sorted(map(tuple, collocations.collocations(docs, 5, most_words, 50, top).collect())) == expected
        if top > 100:
            break
    assert collocations.collocations(docs.limit(0)).isEmpty()


def test_rare_phrases_are_not_counted_by_words(frame, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(300)) for _ in range(8)] + ["new york city, " * 12]
    docs = frame([(t, "en") for t in texts], "text string, lang string")
    counted, count = [], collocations.phrase_counts

    def counts(*args):
        counted.append(count(*args).where("phrase like '% % %'").count())
        return count(*args)

    monkeypatch.setattr(collocations, "phrase_counts", counts)
    expected = phrases([(t, "en") for t in texts])
    assert len(expected) > 100
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == expected
    assert counted[-1] < 50  # of some 1,300 kinds of three words whose pairs are frequent


@pytest.mark.parametrize("least", [7, 300])
def test_hashes_sent_in_parts(frame, monkeypatch, least):
    monkeypatch.setattr(collocations, "SENT_HASHES", 4)
    monkeypatch.setattr(collocations, "MET_HASHES", 4)
    rows = [("a b c d, " * (k + 1) + f"x{k} y z", "en" if k % 2 else "de") for k in range(40)]
    docs = frame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, least).collect())) == phrases(rows, least)


def test_hashes_move_as_differences():
    r = np.random.default_rng(3)
    for n, group_bits in ((0, 4), (1, 4), (300, 7), (1 << 20, 7)):
        rows = r.integers(0, 1 << collocations.HASH_BITS, n) << 8 | r.integers(1, 9, n)
        found, numbers = collocations.summed(np.concatenate([rows, rows[: n // 2]]), 10)
        sent = list(collocations.gaps(found, numbers, group_bits))
        assert np.array_equal(np.concatenate([found[:0], *(collocations.hashes_of(g, x, group_bits) for g, x, _ in sent)]), found)
        assert b"".join(x for _, _, x in sent) == numbers.astype(np.uint8).tobytes()
        assert set(found.tolist()) == {x >> 8 for x in rows.tolist()} and numbers.max(initial=0) <= 10
    assert sum(len(x) for _, x, _ in sent) < 3 * len(found)


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    rows = spark.createDataFrame([("en", "x y", big - 1)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("en", "x", big), ("en", "y", big)], "lang string, phrase string, f long")
    assert collocations._scored(rows, 1, [parts]).first().score == 1_000_000 * (big - 1) ** 2 // big**2
