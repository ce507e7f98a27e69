import random
import re

import numpy as np
import pytest

from wardlight.llm import cells, jaccard, store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(x), None if d is None else find(d)) for d, x in sets if d is not None)


def families(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    shared = [word() for _ in range(40)]
    out = []
    for f in range(5):
        base = [word() for _ in range(rng.choice([30, 60, 110, 150]))]
        for _ in range(rng.choice([3, 12, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = [word()] * rng.choice([0, 1, 1])
            if f == 1:
                copy = shared + copy
            out.append(" ".join(copy))
    out += [" ".join(shared + [word() for _ in range(60)]) for _ in range(15)]
    out += ["", "  ", "one", "One", "two words", "two  words", out[0], out[0].upper(), out[5]]
    rng.shuffle(out)
    return list(enumerate(out, start=3))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    rows = families(seed) + [(900, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "A B C D"), (8, None)], "doc_id long, text string").selectExpr("*", "1 as n", "'x' as component_id")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == [(-1, 2, None), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 2, 7)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def connected(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[find(i)] = find(j)
    return [frozenset(j for j in range(n) if find(j) == find(i)) for i in range(n)]


@pytest.mark.parametrize("percent", [80, 90])
def test_links_of_a_cell_match_brute_force(percent):
    rng = np.random.default_rng(percent)
    for trial in range(100):
        m, base = int(rng.integers(2, 25)), rng.integers(0, 2**40, 60)
        full = []
        for _ in range(m):
            x = base.copy()
            x[rng.integers(0, 60, rng.integers(0, 6))] = 5 if rng.random() < 0.5 else rng.integers(0, 2**40)
            full.append(np.unique(x))
        pivot = full[int(rng.integers(m))] if trial % 3 else np.zeros(0, np.int64)
        got = cells.local_links(np.array([len(x) for x in full]), np.arange(m) * 7, [np.setxor1d(x, pivot) for x in full], percent)
        shared = {(i, j): len(np.intersect1d(full[i], full[j])) for i in range(m) for j in range(i)}
        want = [(i, j) for (i, j), k in shared.items() if 100 * k >= percent * (len(full[i]) + len(full[j]) - k)]
        assert connected(m, got) == connected(m, want) and len(got) < m


def test_large_cells_are_split_until_they_fit(spark, monkeypatch):
    for name, value in (("MEMBERS", 6), ("TOKENS", 60), ("FEW", 3)):
        monkeypatch.setattr(cells, name, value)
    rng = random.Random(8)
    word = lambda: rng.randrange(10**9)
    full, rows = [], []
    base = [word() for _ in range(60)]
    alternatives = [[word() for _ in range(3)] for _ in base]
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(60), rng.randrange(12)):
            copy[at] = rng.choice(alternatives[at])
        full.append(set(copy))
        rows.append(("c", i, len(full[i]), i, sorted(full[i] ^ full[0])))
    scratch = store.Scratch(spark, "t")
    got = cells.join_cells(spark.createDataFrame(rows, "cell string, id long, n long, label long, tokens array<long>"), 90, scratch).collect()
    want = [(i, j) for i in range(90) for j in range(i) if 100 * len(full[i] & full[j]) >= 90 * len(full[i] | full[j])]
    assert connected(90, [(r["a"], r["b"]) for r in got]) == connected(90, want) and 3 < len(set(connected(90, want))) < 60
    assert all(100 * len(full[r["a"]] & full[r["b"]]) >= 90 * len(full[r["a"]] | full[r["b"]]) for r in got)
    scratch.drop()


def test_repeated_ids_and_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))
    rows = [(4, long), (5, long + " more"), (5, other), (6, other + " x"), (6, other + " x"), (8, "a b c"), (8, "d e f")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for (d, _), c in got.items() if d < 7} == {4} and {c for (d, _), c in got.items() if d == 8} == {8}
