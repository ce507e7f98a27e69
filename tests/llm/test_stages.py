import random
import re

import corpus_pipeline as pipe


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(12)
    own = lambda n: [f"n{rng.randrange(9000)}" for _ in range(n)]
    text = own(200)
    copy = list(text)
    for k in (30, 70, 110, 150):
        copy[k] = "other"
    rows = [(1, " ".join(text)), (2, " ".join(copy)), (3, ""), (4, None), (5, "a b c"), (6, "a  b c"), (7, "a b d"), (None, "a b c")]
    for i in range(10, 70):
        part = rng.choice(rows)[1] if i % 2 and i > 20 else None
        words = part.split() if part and len(part) > 30 else own(rng.randrange(20, 120))
        words = [w if rng.random() > 0.03 else "edit" for w in words]
        rows.append((i, " ".join(words)))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows if i is not None}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted(i for i in sets if find(i) == i)
    got = pipe.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == want and sum(r["doc_id"] is None for r in got) == 1
    assert 1 in want and 2 not in want and 6 not in want and 7 in want and len(want) < len(sets) - 5
