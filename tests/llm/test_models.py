"""Quality model, language centroids and perplexity rules."""

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa

from conceptloom.llm import language, perplexity, quality_model
from conceptloom.llm.common import read_table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = quality_model.score_documents(docs, quality_model.train(docs, labels)).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_additive_model_learns_a_pair():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert (model.pairs[0] in ((1, 0), (0, 1))) and ((model.score(x) > 0.5) == y).mean() > 0.97
    assert quality_model.fit(np.zeros((0, 20)), np.zeros(0)).score(np.zeros((2, 20))).tolist() == [0.5, 0.5]


def test_quality_edge_cases(frame, documents):
    docs = documents(["", None, "a " * 50_000, "x\ny\nx"], extra=[(None, "t", None, None, None)])
    model = quality_model.train(docs, frame([(2, 1, 0), (3, 0, 0), (3, 1, 0), (99, None, 1)], "doc_id long, quality int, toxic int"))
    rows = quality_model.score_documents(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score_documents(docs.limit(0), model).isEmpty()


def test_language_on_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs, language.train(docs)).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_language_edge_cases(documents):
    docs = documents(["the cat and the dog", "the house", "", None, "123 !!! ---", "x" * 200_000], extra=[(None, "the end", None, None, None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[0][0] == "en" and got[None][0] == "en"
    assert {r.lang_pred for r in language.identify(docs, language.train(docs.limit(0))).collect()} == {"und"}


def base(text):
    w = WORD.findall(text or "")
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {p + j for places in at.values() if len(places) > 1 for p in places for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts(documents, corpus):
    texts = ["", None, " \n\n \n", "é é é é é é é é é é é é", "a\na\r\na\na", "x|y <b> #1 $ % & *", "one two three four five " * 4, "w\x1cv u\x85t", *corpus.text.head(60)]
    rows = perplexity.quality_rules(documents(texts)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {k: base(t) for k, t in enumerate(texts)}
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert perplexity.quality_rules(documents([]).limit(0)).isEmpty()


def symbols_of(text, shape=str):
    """The n-gram that ends at each predicted symbol of a text, or of the kinds of its symbols."""
    out, tail, n = [], perplexity.START, perplexity.ORDER
    for word in text.split():
        for piece in perplexity.pieces(word):
            w = shape(piece) + perplexity.GAP
            for k in range(len(w)):
                if k >= perplexity.REACH:
                    out.append((perplexity.GAP + w[: k + 1])[-n:])
        w = word + perplexity.GAP
        out += [shape(tail + w[: k + 1])[-n:] for k in range(min(perplexity.REACH, len(w)))]
        tail = (perplexity.GAP + word)[-perplexity.REACH :] + perplexity.GAP
    return out


def plain_kneser_ney(texts, order, shape=str):
    """Probabilities of a plain, recursive model."""
    top = Counter(g for t in texts for g in symbols_of(t, shape))
    counts = {order: Counter({g: c for g, c in top.items() if len(g) == order})}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
        counts[n].update({g: c for g, c in top.items() if len(g) == n and g.startswith(perplexity.START)})

    def discounts(n):
        c = [sum(v == k for v in counts[n].values()) for k in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else None
        out = []
        for k in (1, 2, 3):
            x = k - (k + 1) * y * c[k + 1] / c[k] if y is not None and c[k] else None
            out.append(k / 2 if x is None else max(0.05, min(x, k - 0.05)))
        return out

    d = {n: discounts(n) for n in counts}
    after = {}
    for n in counts:
        for g, c in counts[n].items():
            after.setdefault(g[:-1], {})[g] = c

    @lru_cache(None)
    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        own = after.get(gram[:-1])
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        cut = lambda c: d[n][min(c, 3) - 1]
        return (max(own[gram] - cut(own[gram]), 0) if gram in own else 0) / total + sum(map(cut, own.values())) / total * p(gram[1:])

    return p


def test_kneser_ney_equals_a_plain_model(documents):
    texts = ["abab abc b b ca abab", "cab b abca ca", "bbb b\tbbb ca b", "ca abab b b abc ca", "b"]
    model = perplexity.HashArrays(perplexity.kneser_ney(written(perplexity.count_grams(perplexity.count_words(documents(texts))), "g")))
    p = plain_kneser_ney(texts, perplexity.ORDER)
    tests = [*texts, "abab", "zzz ca", "b zzz b", "", "a" * 70, "cab " * 3]
    got = perplexity.measure(documents(tests), model).collect()
    for r in got:
        grams = symbols_of(tests[r.doc_id])
        # pieces of a long word have no joint of their own: their first symbols are not predicted
        assert abs(r._logp - sum(np.log(p(g)) for g in grams)) < 1e-3, tests[r.doc_id]


def plain_kind(c):
    return c if c in (perplexity.START, perplexity.GAP) else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdecimal() else c if c.isascii() else "?"


def plain_kinds(text):
    out = ""
    for c in map(plain_kind, text):
        if not (c in "Aa0" and len(out) > 1 and out[-1] in "Aa0" and out[-2] in "Aa0"):
            out += c
    return out


def test_kept_by_brute_force(frame, corpus):
    """Every verdict of the table: base rules, two plain models a language over all texts, medians and bands, in plain Python."""
    rows = [(int(r.doc_id), r.text, r.lang) for r in corpus.itertuples()]
    rows += [(10_000 + k, t, "en") for k, t in enumerate([None, "", "a b c", "one two three four five six seven eight nine ten 4" + "7" * 90, " | ".join("onea two".split() * 9)])]
    got = {r.doc_id: r for r in perplexity.quality_rules(frame(rows, "doc_id long, text string, lang string")).collect()}
    off = {}
    for lang in {r[2] for r in rows}:
        texts = {i: t or "" for i, t, x in rows if x == lang}
        fine = [i for i in texts if not got[i].base_failed]
        for shape in (str, plain_kinds):
            p = plain_kneser_ney(list(texts.values()), perplexity.ORDER, shape)
            n = {i: len(texts[i].split()) for i in fine}
            nats = {i: -sum(np.log(p(g)) for g in symbols_of(texts[i], shape)) / n[i] for i in fine}
            middle = np.median(list(nats.values()))
            wide = 1.4826 * np.median([abs(nats[i] - middle) * n[i] ** 0.5 for i in fine])
            for i in fine:
                band = perplexity.DEVIATIONS * max(wide / n[i] ** 0.5, perplexity.FLOOR) + (perplexity.SPARE / n[i] if shape is plain_kinds else 0)
                off.setdefault(i, []).append(abs(nats[i] - middle) - band)
    assert len(off) > 100 and {i for i in got if got[i].base_failed} == set(got) - set(off)
    sure = {i: max(x) < 0 for i, x in off.items() if min(map(abs, x)) > 0.01}
    assert len(sure) > 0.95 * len(off) and not all(sure.values())
    assert {i: got[i].kept for i in sure} == sure


def test_order_of_words_counts(documents):
    r = np.random.default_rng(5)
    texts = [" ".join(["dar", "eko", "ilm", "nup"][k % 4] for k in range(s, s + 60)) for s in r.integers(0, 4, 40)]
    shuffled = [" ".join(r.permutation(t.split())) for t in texts[:10]]
    model = perplexity.HashArrays(perplexity.kneser_ney(written(perplexity.count_grams(perplexity.count_words(documents(texts))), "g")))
    logp = {x.doc_id: x._logp for x in perplexity.measure(documents([*texts[:10], *shuffled]), model).collect()}
    assert all(logp[k + 10] < logp[k] - 20 for k in range(10))


def test_scores_by_join_equal_scores_by_arrays(documents, corpus):
    docs = documents([*corpus.text.head(25), "", None, "q" * 100])
    of = lambda most: {r.doc_id: (r._words, r._predicted, round(r._logp, 5), round(r._shaped, 5), r._kept) for r in perplexity.judged(docs, broadcast_entries=most).collect()}
    assert of(10**9) == of(0)


def test_long_words_are_counted_and_scored_whole(documents):
    """Every symbol of a word of any length is predicted, with the symbols before it."""
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abé\U0001F600#"), n)) for n in (30, 31, 32, 33, 34, 35, 36, 63, 64, 65, 66, 67, 300)]
    docs, whole, order = documents([*words, "ab"]), [], perplexity.ORDER
    for w in [*words, "ab"]:
        w = perplexity.GAP + w + perplexity.GAP
        whole += [w[k + 1 - order : k + 1] for k in range(order - 1, len(w))]
    grams = perplexity.count_grams(perplexity.count_words(docs).where("not joint"))
    assert {x.gram: x.n for x in grams.collect()} == Counter(whole)
    rows = {x.doc_id: x for x in perplexity.judged(docs).collect()}
    assert [rows[k]._predicted for k in range(len(words))] == [len(w) + 1 for w in words]
    joined = {x.doc_id: x for x in perplexity.judged(docs, broadcast_entries=0).collect()}
    assert {k: round(x._logp, 5) for k, x in rows.items()} == {k: round(x._logp, 5) for k, x in joined.items()}


def test_gram_hashes_tell_languages_apart():
    codes = np.array([1, 2, 3, 4], np.uint64)
    a, b = (perplexity.gram_hash(codes, np.array([3, 4]), 2, perplexity.lang_seed(x)) for x in ("en", "de"))
    assert len({*a.tolist(), *b.tolist()}) == 4
    assert isinstance(pa.array(a), pa.Array)


def test_bands_catch_labelled_junk(spark):
    """Of labelled texts that pass the base rules, both sides together reject nearly all junk and hardly any clean text."""
    sf = "/root/testdata/sf0.01"
    rows = perplexity.quality_rules(read_table(spark, sf, "documents")).join(read_table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(junk) > 10 and sum(junk) / len(junk) < 0.1 and sum(clean) / len(clean) > 0.98
    assert all((r.side == 0) == r.kept for r in rows)


def test_rows_survive_as_they_are(frame):
    schema = "doc_id long, text string, lang string, _key string, _a int, words string"
    good = "the quick brown foxes jumped over these lazy dogs near that quiet river bank"
    rows = [(1, good, "en", "k", 1, "w"), (1, good, "en", "k", 1, "w"), (None, good, None, "k", 1, "w"), (2, "", "en", "k", 1, "w"), (3, None, "en", "k", 1, "w"), (4, "few words", "en", "k", 1, "w")]
    docs = frame(rows, schema)
    kept = perplexity.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:3], key=str)
    judged = perplexity.quality_rules(docs).collect()
    assert len(judged) == 6 and sorted((r.doc_id or 0, r.n_words) for r in judged) == [(0, 14), (1, 14), (1, 14), (2, 0), (3, 0), (4, 2)]


def test_each_side_of_a_band_rejects_junk(documents):
    r = np.random.default_rng(3)
    parts = "an be con der el fi gra hol in jo ka lum mer no".split()
    text = lambda n: " ".join("".join(r.choice(parts, r.integers(1, 5))) for _ in range(n))
    clean = [text(120) for _ in range(150)]
    marked = " ".join(w + "#$%"[k % 3] * 3 for k, w in enumerate(text(120).split()))
    barred = text(120).replace(" ", " | ")
    short = " ".join(r.choice(parts, 120))  # lies below the spelling's band
    rare = " ".join("".join(r.choice(list("qxzwvy"), 8)) for _ in range(120))  # lies above it
    rows = {x.doc_id: x.kept for x in perplexity.quality_rules(documents([*clean, marked, barred, short, rare])).where("not base_failed").collect()}
    assert [rows[k] for k in range(150, 154)] == [False] * 4 and all(rows[k] for k in range(150))
