import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardlight.llm import components, decontaminate, html_extract, langid, line_dedup, mixing, queries, sharding, store, substring_dedup, url_filters

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 3)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df, store.Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(df.limit(0), store.Scratch(spark, "t")).count() == 0


def test_language_held_out_and_edges(spark):
    got = queries.op1_langid(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 150 and np.mean(held) > 0.97
    model = langid.Model(["x", "y"], *(np.zeros(s, np.float32) for s in ((2, 256, 8), (2, 4, 4), (2, 4, 4), (2, 4, 2), (2,))))
    rows = [(1, None, 5), (2, "", 5), (3, "12 !", 5), (4, "abc", 5), (4, "abc", 5), (None, "é" * 5000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out.collect()) == [(0, "x"), (1, "und"), (2, "und"), (3, "und"), (4, "x"), (4, "x")]
    assert langid.identify(df.limit(0), model).count() == 0 and langid.fit(df.select("text", F.lit(None).cast("string").alias("lang"), "doc_id")) is None


def test_language_result_does_not_depend_on_neighbours():
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()[:40]
    model = langid.train([t.encode()[:300] for t in texts[:20]], ["a", "b"] * 10, rounds=3)
    together = langid.pooled(model, pa.array(texts))
    alone = np.concatenate([langid.pooled(model, pa.array([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together.sum(axis=1), 1, atol=1e-4)


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    h, k = 3, 4
    w = {"table": rng.standard_normal((2, 256, 2 * h)), "gate": rng.standard_normal((2, h, h)), "state": rng.standard_normal((2, h, h)), "out": rng.standard_normal((2, h, k)), "bias": rng.standard_normal(k)}
    data, target = rng.choice(np.frombuffer("abc é1 ".encode(), dtype=np.uint8), (9, 5)), rng.integers(0, k, 5)
    loss, g = langid.gradients(w, data, target)
    assert loss > 0
    for name, x in w.items():
        places = [(0, int(b), int(rng.integers(2 * h))) for b in np.unique(data)[:3]] if name == "table" else [tuple(int(rng.integers(n)) for n in x.shape) for _ in range(4)]
        for at in places:
            ends = []
            for step in (1e-5, -1e-5):
                x[at] += step
                ends.append(langid.gradients(w, data, target)[0])
                x[at] -= step
            assert abs((ends[0] - ends[1]) / 2e-5 - g[name][at]) < 1e-6, (name, at)


def test_training_tells_two_alphabets_apart():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"aeiou"), 64)) for _ in range(20)] + [bytes(rng.choice(list(b"xzqkw"), 64)) for _ in range(20)]
    model = langid.train(texts, ["v"] * 20 + ["c"] * 20, rounds=60, batch=32, length=32)
    p = langid.pooled(model, pa.array([t.decode() for t in texts]))
    assert (p.argmax(axis=1) == np.array([model.labels.index(x) for x in ["v"] * 20 + ["c"] * 20])).mean() == 1.0


def test_network_matches_a_plain_loop():
    """Pooled probabilities of a text, against the network written out step by step for one byte at a time."""
    rng = np.random.default_rng(2)
    h, k = 4, 3
    m = langid.Model(["a", "b", "c"], *(rng.standard_normal(s).astype(np.float32) for s in ((2, 256, 2 * h), (2, h, h), (2, h, h), (2, h, k), (k,))))
    for text in ("Some words, éü 12.", "x" * 300 + " y", "é"):
        raw = text.encode()
        states = []
        for d, order in ((0, raw), (1, raw[::-1])):
            s, out = np.zeros(h), []
            for byte in order:
                x = m.table[d][byte].astype(float)
                f = 0.5 * np.tanh(x[:h] + s @ m.gate[d]) + 0.5
                s = s + f * (np.tanh(x[h:] + (f * s) @ m.state[d]) - s)
                out.append(s)
            states.append(out if d == 0 else out[::-1])
        total, n = np.zeros(k), 0
        for t, byte in enumerate(raw):
            if langid.LETTER[byte]:
                z = np.exp(states[0][t] @ m.out[0] + states[1][t] @ m.out[1] + m.bias)
                total, n = total + z / z.sum(), n + 1
        assert np.allclose(langid.pooled(m, pa.array([text]))[0], total / n, atol=1e-4)


def test_every_label_is_learned(spark):
    rows = [(i, f"text of label {i % 90} " * 3, f"l{i % 90}") for i in range(450)] + [(500, "a" * 5000 + "b" * 5000, "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df, a_label=3, most_rows=1000).collect()
    assert Counter(r["lang"] for r in got) == {f"l{i}": 3 for i in range(90)} and max(len(r["text"]) for r in got) <= 1200
    assert len(langid.sample(df, a_label=3, most_rows=100).collect()) == 90


def test_shards_are_exact_random_and_stable(spark):
    rows = [(i, f"t{i % 50}", "s") for i in range(1003)] + [(None, None, None), (5, "t5", "s"), (5, "t5", "s")]
    df = docs_of(spark, rows).withColumn("shard", F.lit("clash"))
    got = sharding.shard(df, 24, rows_a_block=64).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and sorted(slots) == list(range(24))
    assert sharding.shard(docs_of(spark, [(None, f"t{i}", "s") for i in range(500)]), 4, rows_a_block=16).groupBy("shard").count().select("count").distinct().collect() == [(125,)]
    assert {len(s) for s in slots.values()} <= {len(rows) // 24, len(rows) // 24 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(df.repartition(5), 24, rows_a_block=64).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15
    assert sharding.shard(df.limit(0)).count() == 0


def test_communication_matrix_and_large_draws():
    m = np.array(sharding.communication_matrix([10, 0, 25, 7], [14, 14, 14], 3))
    assert m.sum(axis=1).tolist() == [10, 0, 25, 7] and m.sum(axis=0).tolist() == [14, 14, 14]
    rng = np.random.Generator(np.random.PCG64(1))
    good, bad, draws = 3 * 10**9, 7 * 10**9, 10**6
    x = [sharding._hypergeometric(rng, good, bad, draws) for _ in range(300)]
    assert abs(np.mean(x) - 300_000) < 5 * 458 / 300**0.5 * 1.2 and 380 < np.std(x) < 540


def test_mix_invariants(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 90])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(2000)] + [(7, None, "a"), (8, "x x", "b"), (8, "x x", "b")]
    df = docs_of(spark, rows)
    got = mixing.mix_sources(df, rows_a_bucket=128).collect()
    total, by = sum(r["size"] for r in got), defaultdict(int)
    for r in got:
        by[r["source"]] += r["size"] * r["repeats"]
        assert 0 <= r["repeats"] <= 2
    target = {r["source"]: r["target"] for r in got}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total and sum(by.values()) <= 1.5 * total
    assert all(abs(by[s] - target[s]) <= 200 for s in target) and sum(by.values()) > 1.5 * total - 200
    again = mixing.mix_sources(df.repartition(7), rows_a_bucket=4096).collect()
    assert sorted((r["doc_id"], r["repeats"]) for r in again) == sorted((r["doc_id"], r["repeats"]) for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([14, 25, 3, 1, 10, 0])] + [(99, None), (98, "W1 w2-w3")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + " X, " + (items[i % 5][1].upper() if i % 3 else "")) for i in range(60)] + [(70, None), (71, ""), (72, items[1][1] + " " + items[1][1])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for d, t in rows:
        w, hit, found = low(t), set(), set()
        for i, x in items:
            v = low(x)
            for k in range(max(1, len(v) - 9) if v else 0):
                win = v[k : k + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 23, 60):
        decontaminate.ITEMS_AT_ONCE, before = limit, decontaminate.ITEMS_AT_ONCE
        try:
            got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
        finally:
            decontaminate.ITEMS_AT_ONCE = before
        assert got == want
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x d e f g h i j"), (2, "a b c d e f g h i j")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c d e f g h i j")], "item_id long, text string")
    hits = lambda slop: sorted(r["doc_id"] for r in decontaminate.find_contamination(docs, bench, slop).where("n_hit > 0").collect())
    assert hits(0) == [2] and hits(1) == [1, 2]


def passage(rng, n):
    return " ".join(f"p{rng.randrange(5000)}" for _ in range(n))


def test_passages_anywhere_are_found_and_cut(spark):
    rng = random.Random(4)
    shared = passage(rng, 60)
    rows = [(i, passage(rng, 50) + " " + (shared + " " if i < 10 else "") + passage(rng, 50), "s") for i in range(40)] + [(90, None, "s"), (91, "", "s"), (92, "too short", "s"), (93, "too short", "s")]
    line = passage(rng, 60)
    rows += [(94, "x\n" + line, "s"), (95, line.replace(line.split()[30], "other") + "\ny", "s")]
    df = docs_of(spark, rows)
    found = substring_dedup.repeated_passages(df)
    per = {r["doc_id"]: r for r in substring_dedup.by_document(found).collect()}
    assert set(per) == {*range(10), 94, 95}
    assert per[0]["n_removed_words"] == 0 and all(per[i]["n_removed_words"] >= 20 for i in (*range(1, 10), 95))
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(df, found).collect()}
    assert cut[0] == rows[0][1] and len(WORD.findall(cut[5])) == 160 - per[5]["n_removed_words"] and cut[90] is None
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_line_chunks_are_removed_but_for_the_first(spark):
    rng = random.Random(6)
    block = "\n".join(passage(rng, 6) for _ in range(30))
    rows = [(i, "\n".join(passage(rng, 5) for _ in range(i % 7)) + "\n" + block + "\nend " + str(i), "s") for i in range(12)] + [(20, None, "s"), (21, "", "s"), (22, "one line", "s"), (23, "one line", "s")]
    df = docs_of(spark, rows)
    chunks = line_dedup.repeated_chunks(df)
    s = {r["doc_id"]: r for r in line_dedup.line_summary(df, chunks).collect()}
    assert s[0]["n_removed_lines"] == 0 and all(s[i]["n_removed_lines"] >= 24 for i in range(1, 12)) and s[22]["n_removed_lines"] == s[23]["n_removed_lines"] == 0
    cut = {r["doc_id"]: r["text"] for r in line_dedup.remove_chunks(df, chunks).collect()}
    assert cut[0] == rows[0][1] and cut[3].endswith("end 3") and len([x for x in cut[3].split("\n") if x]) == s[3]["n_lines"] - s[3]["n_removed_lines"]
    assert cut[20] is None and line_dedup.repeated_chunks(df.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "http://A.example.org/es/x", ""), (2, "https://q.example.net/a?b#c", '<link rel="canonical" href="//z.example.org/es/1">'), (3, "http://q.example.net/c", '<meta http-equiv=refresh content="0;url=/a?b">'),
        (4, "http://x.com/fr/1", "<link href='http://q.example.net/c' rel=canonical>"), (5, None, None), (6, "nope", ""), (8, "http://u.net", None), (9, "http://notorg/es/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    redirects = spark.createDataFrame([("http://short.net/1", "http://u.net/"), ("http://short.net/1", "http://w.com/de/2")], "from_url string, to_url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["decided_by"]) for r in url_filters.filter_urls(df, redirects=redirects).collect()}
    assert got[1] == ("example.org/es/", "block", "rule") and got[4] == ("com/fr/", "allow", "rule")
    assert got[2] == got[3] == got[8] == (None, "block", "alias")
    assert got[5] == got[6] == got[9] == (None, "allow", "default")


PAGE = "<html><head><title>T</title><script>x<p>y</script></head><body><nav><a href=/>Home</a></nav><div class='{cls}'><h2>Head &amp; more</h2><p>One  two<br>three<p>Four &lt;5<div class=ad>Buy</div><ul><li>a<li>b</ul></div><section id=comments><p>nice</p></section><aside>side</aside><form>f</form><footer>foot</footer></body></html>"


def test_html_by_host_consensus(spark):
    rows = [(i, f"https://H.test/{i}", PAGE.format(cls=f"post-{i} entry")) for i in range(5)] + [(10, None, None), (11, "https://H.test/x", ""), (12, "x", "just text"), (13, "https://o.test/", "<article><p>A</p><p>B &am")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Head & more\nOne two\nthree\nFour <5\na\nb" for i in range(5))
    assert got[10] == got[11] == "" and got[12] == "just text" and got[13] == "A\nB &am"


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").withColumn("size", F.lit(3)).withColumn("_n", F.lit(1))
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", "'12 34' as text", "lang", "source", "n_chars", "size", "_n"))
    sf, scratch = "/root/testdata/sf0.01", store.Scratch(spark, "t")
    steps = {}
    for name, stage in pipe.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf))
        steps[name] = (before, docs)
        if name != "shards":
            assert docs.columns == before.columns
    ids = {n: (sorted(r[0] for r in a.select("doc_id").where("doc_id is not null").collect()), sorted(r[0] for r in b.select("doc_id").where("doc_id is not null").collect())) for n, (a, b) in steps.items()}
    assert ids["language"][0] == ids["language"][1] and steps["language"][1].where("doc_id is null").isEmpty()
    bench = [x["text"] for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    wins = {tuple(w[k : k + 10]) for t in bench for w in [low(t)] for k in range(max(1, len(w) - 9))}
    bad = {r["doc_id"] for r in steps["decontamination"][0].collect() for w in [low(r["text"])] if any(tuple(w[s : s + n]) in wins for n in {len(x) for x in wins} for s in range(len(w) - n + 1))}
    assert ids["decontamination"][1] == [i for i in ids["decontamination"][0] if i not in bad] and bad
    assert set(ids["mixture"][1]) <= set(ids["mixture"][0]) and ids["shards"][0] == ids["shards"][1]


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_blocks_of_candidates_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    terms = np.minimum(rng.zipf(1.3, 4000), 60).astype(np.uint64)
    order = np.argsort(terms, kind="stable")
    names, counts = np.unique(terms, return_counts=True)
    segment = decontaminate.Segment(names, np.cumsum(counts), order.astype(np.int64))
    windows = np.stack([terms[k : k + 10] for k in range(0, 3900, 7)])
    lengths = np.full(len(windows), 10, dtype=np.int64)
    whole = sorted(zip(*(x.tolist() for x in decontaminate.phrase_starts(segment, windows, lengths)), strict=True))
    monkeypatch.setattr(decontaminate, "CANDIDATES", 50)
    assert sorted(zip(*(x.tolist() for x in decontaminate.phrase_starts(segment, windows, lengths)), strict=True)) == whole
    want = [(i, s) for i, w in enumerate(windows) for s in range(3991) if (terms[s : s + 10] == w).all()]
    assert whole == sorted(want)


def test_mix_without_ids_and_with_clashing_names(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 7)) + f" t{i}", "a") for i in range(3000)] + [(None, f"x{i}", "b") for i in range(200)]
    df = docs_of(spark, rows).selectExpr("*", "'k' as last", "1 as _p", "2 as name", "3 as p", "4 as target")
    got = mixing.mix_sources(df, rows_a_bucket=256)
    assert set(got.columns) == {"doc_id", "text", "source", "last", "_p", "name", "p", "size", "source_size", "target", "repeats"}
    by = {r["source"]: (r["t"], r["got"]) for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("repeats")).alias("got")).collect()}
    assert all(abs(t - n) <= 20 for t, n in by.values()), by


def test_very_long_texts_in_index_mix_and_shards(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    df = docs_of(spark, [(1, long, "a"), (2, "short one", "a"), (3, None, None)])
    bench = spark.createDataFrame([(1, " ".join(f"w{i % 977}" for i in range(970, 990)))], "item_id long, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.find_contamination(df, bench).collect()}
    assert hits[1][0] == 300_000 and hits[1][1] == 20 * (300_000 // 977) + 13 and hits[2][1] == 0
    assert mixing.mix_sources(df).count() == 3 and sharding.shard(df, 2).count() == 3
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.train([b"w1 w2 w3", b"zz yy xx"], ["x", "y"], rounds=2)).collect()}
    assert found[1] in ("x", "y") and found[3] == "und"


def test_items_of_any_length_are_asked_in_pieces(spark, monkeypatch):
    rng = random.Random(12)
    item = lambda n: " ".join(rng.choices(["ab", "c", "d-e", "Ééé", "f1"], k=n))
    items = [(i, item(n)) for i, n in enumerate([0, 1, 9, 10, 11, 19, 20, 21, 300, 2500])] + [(77, "w" * 5000 + " x"), (78, None)]
    long = items[9][1]
    rows = [(i, long[a : a + 400], "s") for i, a in enumerate(range(0, 6000, 130))] + [(900, long, "s"), (901, items[8][1] + " " + items[5][1], "s"), (902, "w" * 5000 + " x", "s")]
    df, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], sorted(map(tuple, r["spans"]))) for r in decontaminate.find_contamination(df, bench).collect()}
    whole = found()
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    assert found() == whole and whole[900][0] == whole[900][1] and "77" in whole[902][2]
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 5000)
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 250_000)  # less than the windows of one item
    assert found() == whole
