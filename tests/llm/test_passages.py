import random

import numpy as np
import pyarrow as pa

from wardlight.llm import substring_dedup as sd
from wardlight.llm import textops


def prose(rng, n):
    return [f"v{rng.randrange(4000)}" for _ in range(n)]


def exact_clusters(rows):
    """{(doc_id, start, n_words): index of cluster} of all units, by comparing each two of them; a cluster within one document is left out."""
    spots = []
    for d, t in rows:
        _, start, count, _, first, w = sd.units(pa.array([t]))
        runs = textops.shingles(w.hash, sd.SHINGLE)
        spots += [((d, int(s), int(c)), frozenset(runs[f : f + c - sd.SHINGLE + 1].tolist())) for s, c, f in zip(start, count, first, strict=True)]
    spots = list(dict(spots).items())
    sets = list({x: None for _, x in spots})
    index = {x: i for i, x in enumerate(sets)}
    holders = {}
    for i, x in enumerate(sets):
        for token in x:
            holders.setdefault(token, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in {k for token in x for k in holders[token] if k > i}:
            both = len(x & sets[j])
            if both >= 0.8 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    clusters = {}
    for spot, x in spots:
        clusters.setdefault(find(index[x]), set()).add(spot)
    return {frozenset(c) for c in clusters.values() if len({d for d, _, _ in c}) > 1}


def found_clusters(spark, rows):
    clusters = {}
    for r in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        clusters.setdefault(r["cluster"], set()).add((r["doc_id"], r["start"], r["n_words"]))
    return {frozenset(c) for c in clusters.values()}


def test_near_copies_behind_boilerplate_are_all_found(spark):
    rng = random.Random(8)
    phrase, rows = prose(rng, 40), []
    for i in range(0, 300, 2):
        own = prose(rng, 30)
        text = own[:15] + phrase + own[15:]
        copy = list(text)
        copy[rng.choice([0, 1, 2, 68, 69])] = "changed"
        rows += [(i, " ".join(text)), (i + 1, " ".join(copy))]
    lone = prose(rng, 60)  # two near copies in one document, of which one only has a copy elsewhere
    rows += [(900, " ".join(lone) + "\n" + " ".join([*lone[:-1], "a", "b"])), (901, " ".join([*lone[:-1], "a", "b", "c", "d", "e", "f", "g"]))]
    want = exact_clusters(rows)
    assert sum({(i, 0, 70), (i + 1, 0, 70)} <= c for i in range(0, 300, 2) for c in want) == 150
    assert found_clusters(spark, rows) == want


def test_passages_in_short_lines_and_across_line_ends(spark):
    rng = random.Random(9)
    wrap = lambda words, n: "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))
    whole, part = prose(rng, 120), prose(rng, 51)
    rows = [(1, wrap(whole, 10)), (2, wrap(whole, 13)), (3, wrap(prose(rng, 33) + part + prose(rng, 40), 25)), (4, wrap(prose(rng, 40) + part + prose(rng, 27), 11)), (5, wrap(prose(rng, 200), 12)), (6, "\n".join(prose(rng, 25)))]
    rows.append((7, wrap(rows[5][1].split(), 6)))
    got = {r["doc_id"]: r["n_removed_words"] for r in sd.by_document(sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7} and got[1] == got[3] == got[6] == 0 and got[2] >= 80 and got[4] >= 20 and got[7] == 20
    assert found_clusters(spark, rows) == exact_clusters(rows)


def test_every_shared_run_holds_a_passage_of_both():
    rng = random.Random(10)
    for _ in range(200):
        run = prose(rng, 2 * sd.LEAST)
        a, b = prose(rng, rng.randrange(60)), prose(rng, rng.randrange(60))
        texts = pa.array([" ".join(a + run + prose(rng, rng.randrange(60))), " ".join(b + run + prose(rng, rng.randrange(60)))])
        owner, start, count, is_line, _, _ = sd.units(texts)
        inside = [{int(s) - n for s in start[(owner == i) & ~is_line] if n <= s <= n + sd.LEAST} for i, n in ((0, len(a)), (1, len(b)))]
        assert inside[0] & inside[1]
        alone = [sd.units(texts[i : i + 1]) for i in (0, 1)]
        assert np.concatenate([x[1][~x[3]] for x in alone]).tolist() == start[~is_line].tolist() and (count[~is_line] == sd.LEAST).all()


def test_recall_of_drifting_paragraphs(spark):
    """Families that drift by a word a step: few pairs with the head of a band, many between others."""
    rng = random.Random(11)
    rows = []
    for f in range(40):
        line = prose(rng, 60)
        for k in range(8):
            rows.append((10 * f + k, " ".join(line)))
            line[rng.choice([*range(4), *range(56, 60)])] = f"x{rng.randrange(10**6)}"
    want, got = exact_clusters(rows), found_clusters(spark, rows)
    together = lambda clusters: {(a, b) for c in clusters for a in c for b in c if a < b}
    assert len(together(want)) > 400 and len(together(want) & together(got)) >= 0.98 * len(together(want)) and together(got) <= together(want)


def test_passages_do_not_depend_on_partitions_or_neighbours(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, nine = (sorted(map(tuple, sd.by_document(sd.repeated_passages(x)).collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert one == nine and one
    texts = pa.array([t for _, t in rows[:60]])
    owner, start, count, *_ = sd.units(texts)
    for i in range(60):
        _, s, c, *_ = sd.units(texts[i : i + 1])
        assert sorted(zip(s.tolist(), c.tolist(), strict=True)) == sorted(zip(start[owner == i].tolist(), count[owner == i].tolist(), strict=True))


def test_edges_of_passages(spark):
    rng = random.Random(12)
    same, other = prose(rng, 50), prose(rng, 50)
    rows = [(1, " ".join(same)), (2, " ".join(same)), (2, " ".join(other)), (3, " ".join(other)), (None, " ".join(same)), (4, None), (5, ""), (6, "la " * 200), (7, "la " * 150), (8, " ".join(prose(rng, 30_000) + same))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as spans", "'k' as cut", "1 as h", "2 as c0")
    found = sd.repeated_passages(df)
    per = {r["doc_id"]: r["n_removed_words"] for r in sd.by_document(found).collect()}
    assert set(per) == {1, 2, 3, 6, 7, 8} and per[1] == 0 and per[6] == 180
    out = sd.remove_passages(df, found)
    assert out.columns == df.columns and out.where("spans = 7 and cut = 'k' and h = 1 and c0 = 2").count() == len(rows)
    left = sorted((r["doc_id"] or 0, len((r["text"] or "").split())) for r in out.collect())
    assert (1, 50) in left and (0, 50) in left and [n for d, n in left if d == 2][0] < 25 and [n for d, n in left if d == 8][0] < 30_040


def test_every_document_has_a_row(spark, tmp_path):
    from wardlight.llm import queries

    shared = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, shared), (2, shared + " end"), (3, "alone"), (4, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert all(got[i]["n_passages"] > 0 for i in (1, 2)) and all(sum(got[i][c] for c in got[i].asDict() if c != "doc_id") == 0 for i in (3, 4, 5))
