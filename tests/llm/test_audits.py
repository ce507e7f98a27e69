"""Source divergence, near vectors and the filter audit against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from wardlight.llm import divergence, embedding_dedup, filter_audit

DOCS = "doc_id long, text string, lang string, source string, n long"


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)] + ["É", "straße", "ABC", "x1y", "a*b"]
    out = []
    for i in range(n):
        text = None if rng.random() < 0.05 else rng.choice([" ", "\n", "  "]).join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([0, 1, 3, 60, 250, 400])))
        if out and rng.random() < 0.3:
            text = rng.choice(out)[1]
        out.append((None if rng.random() < 0.05 else i // 2 if rng.random() < 0.1 else i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "ç", "Z", None]), 7))
    return out + out[:3]


def audit_by_hand(docs, labels):
    least: dict = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((lang or "", {f for f in bad if bad[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, again = [r for r in left if f in r[1]], sum(f in r[1] for r in mine)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), again - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_audit_equals_every_order_by_hand(spark):
    docs = texts(3, 60)
    labels = [(i, 1 if i % 2 else 0, 1 if i % 5 == 0 else None) for i in range(0, 50, 3)] + [(3, 0, 1), (None, 1, 1), (999, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS.replace("n long", "mask long")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in got} == audit_by_hand(docs, labels) and len(got) == 3 * 600


def test_audit_of_nothing_of_one_part_and_of_a_very_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).count() == 0
    long = "Word " * 400_000
    docs = [(1, long, "en", "a", 0), (2, long, "en", "a", 0), (None, long, "en", "a", 0)]
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(spark.createDataFrame(docs, DOCS), none).collect()}
    assert len(got) == 600 and got["EABCD", 1]["removed"] == 1 and got["BACDE", 1]["removed"] == 3 and got["BACDE", 5]["redundant"] == 1 and got["CABDE", 1]["good_lost"] == 0


def test_parts_and_counts_are_summed_exactly():
    masks, labels, times = np.array([1, 31, 0, 31]), np.array([0, 3, 1, 3]), np.array([2**60 + 1, 5, 2**59 + 3, 7])
    rows = filter_audit.report(filter_audit.removals(masks, labels, times))
    first = dict(zip(rows, (v[0] for v in rows.values()), strict=True))
    assert first["removed"] == 2**60 + 13 and first["kept"] == 2**59 + 3 and first["good_lost"] == first["toxic_lost"] == 12


def divergence_by_hand(docs):
    words = lambda t: re.findall(r"[A-Za-z\x80-\U0010FFFF]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    groups, have = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source, *_ in docs:
        w = words(t)
        groups[lang or "", source or ""].update(w)
        have[lang or ""].update(set(w))
    out = {}
    for lang in have:
        kept = sorted(t for t, n in have[lang].items() if n >= 10)
        own = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pairs = [("pair", x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in own if x != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, 10)):
                for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out[lang, s, kind, item] = (value, rank)
    return out


@pytest.mark.parametrize(("terms", "groups"), [(512, 256), (4, 2)])
def test_divergence_equals_integers_by_hand(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    docs = texts(11, 150) + [(900, "", "fr", "only", 1), (901, "rare words here", "it", "x", 1), (902, None, "it", "y", 1)]
    got = divergence.divergence(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got} == divergence_by_hand(docs)
    assert len(got) == len({(r["lang"], r["source"], r["part"], r["item"]) for r in got})


def test_divergence_of_nothing_of_long_terms_and_of_great_counts(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(i, "z" * 300_000 + " b", "en", "a" if i % 2 else "b", 1) for i in range(10)] + [(77, "b " * 200_000, "en", "c", 1)]
    got = divergence.divergence(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got} == divergence_by_hand(docs)
    count, total = np.array([10**15, 7]), np.array([3 * 10**15, 8 * 10**15])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def vectors(seed: int, family: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    far = rng.standard_normal((300, 16))
    near = rng.standard_normal(16) + 0.16 * rng.standard_normal((family, 16))
    chain = [np.cos(0.3 * k) * np.eye(16)[0] + np.sin(0.3 * k) * np.eye(16)[1] for k in range(8)]
    rows = [x.astype(np.float32).tolist() for x in (*far, *near, *chain, far[0] * 3, far[1], far[1], far[1])]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    return [(1000 - i if i % 3 else 5000 + i, v, i % 4) for i, v in enumerate(rows)]


def near_by_hand(rows):
    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: {j for j, y in good if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95} for i, x in good}
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[i] = (len(links.get(i, ())), min(seen), i == min(seen))
    return out, links


@pytest.mark.parametrize(("tile", "aim"), [(4096, 1024), (4096, 32), (64, 1024)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, tile, aim):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "AIM", aim)
    rows = vectors(5, 120)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")).collect()
    assert set(got[0].asDict()) == {"vec_id", "embedding", "key", "n_links", "component_id", "kept"} and len(got) == len(rows)
    found, (want, links) = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}, near_by_hand(rows)
    assert all(found[i][0] <= want[i][0] for i in want)
    total = sum(len(x) for x in links.values())
    assert sum(v[0] for v in found.values()) >= 0.98 * total and total > 5000
    if aim == 1024:  # one bucket: only the count can miss a pair
        assert sum(found[i] != want[i] for i in want) <= 2


def test_recall_of_pairs_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "AIM", 32)
    rng = np.random.default_rng(9)
    a = rng.standard_normal((1000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((1000, 48))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cos = rng.uniform(0.9502, 0.96, 1000)[:, None]
    pairs = cos * a + np.sqrt(1 - cos**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, pairs]))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 2 * 970


def test_near_vectors_of_nothing_without_ids_and_with_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.01, 0.0]
    rows = [(None, x), (None, None), (4, x), (4, y), (2, z), (9, y), (9, y)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [("2", 1, 2, True), ("4", 1, 2, False), ("4", 2, 2, False), ("9", 2, 2, False), ("9", 2, 2, False), ("None", 0, None, True), ("None", 0, None, True)]


def test_a_narrow_cone_of_vectors_still_meets():
    wide, narrow = embedding_dedup.calibrate(10**6, 0.95, 1.0), embedding_dedup.calibrate(10**6, 0.95, 0.02)
    assert wide.bits == 10 and wide.tables <= 12 and narrow.tables <= embedding_dedup.TABLES and narrow.bits < wide.bits
