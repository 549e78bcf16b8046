"""Path counts, first paths, caps at nodes, budgets and word search against plain models."""

import random
from collections import Counter, deque
from statistics import mean, median

import pytest

from conceptloom.operators import search, traversal
from pyspark.sql import functions as F

EDGE = "child string, parent string, pos int"


def parents_of(edges):
    """Of each child its parents in order."""
    up = {}
    for child, parent, pos in sorted(set(edges), key=lambda e: (e[2], e[1])):
        if parent not in up.setdefault(child, []):
            up[child].append(parent)
    return up


def all_paths(up, node, below=()):
    """All simple paths, root first, in order."""
    if node not in up:
        return [[node]]
    return [[*p, node] for b in up[node] if b not in (node, *below) for p in all_paths(up, b, (node, *below))]


def dag(seed, n=12, m=26):
    r = random.Random(seed)
    return [(f"n{a:02}", f"n{b:02}", r.randrange(3)) for a, b in {tuple(sorted((r.randrange(n), r.randrange(n)), reverse=True)) for _ in range(m)} if a != b]


def starts_of(edges):
    return sorted({x for e in edges for x in e[:2]})


@pytest.mark.parametrize("seed", [1])
def test_counts_and_first_paths(frame, seed):
    edges = dag(seed)
    up, codes = parents_of(edges), starts_of(edges)
    links, wanted = frame(edges, EDGE), frame([(c,) for c in [*codes, "elsewhere", codes[0]]], "code string")
    paths = {c: all_paths(up, c) for c in codes}
    for most, caps in ((3, (1,)), (200, (4, 1000))):
        fits = {c: [p for p in paths[c] if len(p) <= most] for c in codes}
        assert {(r.node, r.length, int(r.n)) for r in traversal.path_counts(links, most).collect()} == {(c, k, n) for c in codes for k, n in Counter(map(len, fits[c])).items()}
        for cap in caps:
            got = {(r.code, r["rank"], tuple(r.path)) for r in traversal.first_paths(wanted, links, cap, most).collect()}
            assert got == {(c, k + 1, tuple(p)) for c in codes for k, p in enumerate(fits[c][:cap])}
        got = {(r.code, r["rank"], tuple(r.path)) for r in traversal.first_paths(wanted, links, 3, most, root_first=True).collect()}
        assert got == {(c, k + 1, tuple(p)) for c in codes for k, p in enumerate(sorted(fits[c])[:3])}


def test_statistics_from_counts(frame):
    edges = dag(5)
    up, codes = parents_of(edges), starts_of(edges)
    counts = traversal.path_counts(frame(edges, EDGE)).select(F.lit("g").alias("g"), F.col("node").alias("code"), "length", "n")
    r = traversal.counted_stats(counts, ["g"]).first()
    paths = [all_paths(up, c) for c in codes]
    lengths = [len(p) for x in paths for p in x]
    assert (r.codes, int(r.total_paths), r.min_length, r.max_length) == (len(codes), len(lengths), 1, max(lengths))
    assert r.mean_paths == pytest.approx(mean(map(len, paths))) and r.median_paths == median(map(len, paths)) and r.mean_length == pytest.approx(mean(lengths))


def test_a_ladder_with_two_to_the_forty_paths(frame):
    rungs = 40
    edges = [(f"{k:02}{side}", f"{k - 1:02}{other}", 0) for k in range(1, rungs + 1) for side in "ab" for other in "ab"]
    edges += [("end", f"{rungs:02}{s}", 0) for s in "ab"]
    links, code = frame(edges, EDGE), frame([("end",)], "code string")
    counts = traversal.path_counts(links)
    assert [(r.length, int(r.n)) for r in counts.where("node = 'end'").collect()] == [(rungs + 2, 2 ** (rungs + 1))]
    got = [r.path for r in traversal.first_paths(code, links, 4, counts=counts).orderBy("rank").collect()]
    assert [[x[2] for x in p[:-1]] for p in got] == [["a"] * 41, ["b"] + ["a"] * 40, ["a", "b"] + ["a"] * 39, ["b", "b"] + ["a"] * 39]


def test_empty_tables(frame):
    none, codes = frame([], EDGE), frame([("a",)], "code string")
    for f in (traversal.first_paths, traversal.bounded_paths, traversal.expanded_paths):
        assert f(codes, none).isEmpty()
        assert f(codes.limit(0), frame([("a", "b", 0)], EDGE)).isEmpty()
    assert traversal.path_counts(none).isEmpty()


def with_cycles(seed):
    r = random.Random(seed)
    return [(f"n{r.randrange(9)}", f"n{r.randrange(11)}", r.randrange(3)) for _ in range(19)]


@pytest.mark.parametrize("seed,cap,fallback", [(1, 1000, False), (2, 2, False), (3, 3, True), (4, 1, True)])
def test_caps_at_every_node(frame, seed, cap, fallback):
    edges = with_cycles(seed)
    up, codes = parents_of(edges), starts_of(edges)

    def capped(node, below=()):
        if node not in up:
            return [[node]]
        out = [[*p, node] for b in up[node] if b not in (node, *below) for p in capped(b, (node, *below))]
        return (out or ([[node]] if fallback else []))[:cap]

    got = {(r.code, r["rank"], tuple(r.path)) for r in traversal.bounded_paths(frame([(c,) for c in [*codes, "x"]], "code string"), frame(edges, EDGE), cap, fallback).collect()}
    assert got == {(c, k + 1, tuple(p)) for c in codes for k, p in enumerate(capped(c))}


@pytest.mark.parametrize("seed,budget,steps", [(1, 1, 1), (2, 7, 2), (3, 40, 4)])
def test_a_budget_of_expansions(frame, seed, budget, steps):
    edges = with_cycles(seed)
    up, codes = parents_of(edges), starts_of(edges)

    def queued(code):
        queue, out, taken = deque([[code]]), [], 0
        while queue and taken < budget:
            taken += 1
            path = queue.popleft()
            if path[-1] in up:
                queue.extend([*path, b] for b in up[path[-1]])
            else:
                out.append(path[::-1])
        return out

    expected = {(c, k + 1, tuple(p)) for c in codes for k, p in enumerate(queued(c))}
    got = {(r.code, r["rank"], tuple(r.path)) for r in traversal.expanded_paths(frame([(c,) for c in [*codes, "x"]], "code string"), frame(edges, EDGE), budget, steps).collect()}
    assert got == expected


def test_a_cycle_that_the_budget_alone_stops(frame):
    edges = frame([("a", "b", 0), ("b", "a", 0), ("b", "root", 1), ("x", "y", 0), ("y", "x", 0)], EDGE)
    got = traversal.expanded_paths(frame([("a",), ("x",)], "code string"), edges, 8).orderBy("rank").collect()
    # a, b, a root, b, a root, b: eight ways taken
    assert [(r.code, "".join(x[0] for x in r.path)) for r in got] == [("a", "rba"), ("a", "rbaba")]


@pytest.mark.parametrize("part_rows", [50_000, 3])
def test_search_by_words(spark, frame, part_rows):
    r = random.Random(4)
    words = ["pain", "acute", "heart", "left", "of", "chronic", "ache", "Knee", "disease", "x1y2", "zq"]
    name = lambda n: " ".join(r.choice(words[: r.randrange(2, len(words) + 1)]) for _ in range(n))
    names = [(f"C{k:07}", "ENG" if k % 5 else "FRE", name(r.randrange(1, 6)), k) for k in range(150)] + [("C0000999", "ENG", "", 999), ("C0001000", "ENG", "of", 1000)]
    texts = [(k, name(r.randrange(1, 7))) for k in range(60)] + [(60, ""), (61, None), (62, "of of"), (63, "unheard words"), (64, "HEART-acute, pain!"), (65, "heart acute pain")]
    short = lambda t: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if len(w) >= 3}
    size = lambda t: sum(c.isalnum() for c in t)
    expected = set()
    for k, t in texts:
        found = [(-len(short(t) & short(s)), abs(size(s) - size(t)), line, c) for c, lat, s, line in names if lat == "ENG" and short(t or "") & short(s)] if t else []
        if found:
            shared, _, line, cui = min(found)
            expected.add((k, cui, line, -shared))
    atoms = frame(names, "cui string, lat string, str string, line_no int")
    got = search.search_words(frame(texts, "id int, text string"), search.WordIndex(atoms, part_rows)).collect()
    assert {tuple(x) for x in got} == expected and len(got) == len(expected) > 40
    if part_rows == 3:
        asked = frame(texts, "id int, text string")
        some = search.search_words(asked, search.WordIndex(atoms, part_rows, search.words_of(asked))).collect()
        assert {tuple(x) for x in some} == expected
    assert search.search_words(frame(texts, "id int, text string"), search.WordIndex(atoms.limit(0), part_rows)).isEmpty()


def test_exact_names_come_before_words(frame):
    atoms = frame([("C1", "ENG", "Y", "A", "PT", "1", "heart attack", 1), ("C2", "ENG", "Y", "A", "PT", "2", "attack of the heart muscle", 2), ("C3", "ENG", "Y", "A", "PT", "3", "muscle", 3)], "cui string, lat string, ispref string, sab string, tty string, code string, str string, line_no int")
    got = search.link_by_search(frame([(" Heart attack",), ("muscle heart",), ("nothing",)], "text string"), atoms).collect()
    assert {tuple(r) for r in got} == {(" Heart attack", "C1", "exact_match"), ("muscle heart", "C2", "semantic_containment")}
