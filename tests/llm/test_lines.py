import random

import pyarrow as pa

from wardlight.llm import line_dedup, textops


def plain_chunks(text):
    """(first line, lines, start byte) of the chunks of a text, line by line."""
    lines, at = [], 0
    for line in text.encode().split(b"\n"):
        if line:
            lines.append((line, at))
        at += len(line) + 1
    hashes = [textops.words(*textops.buffers(pa.array([line.decode()])), line_dedup._LINE, False).hash for line, _ in lines]
    top = 2**64 - 1
    key = [int(textops.shingles(__import__("numpy").concatenate([a, b]), 2)[0]) for a, b in zip(hashes, hashes[1:], strict=False)] + [top]
    begins = [i for i in range(len(lines)) if i == 0 or key[i] < key[i - 1] and (i + 1 == len(lines) or key[i] < key[i + 1])]
    begins = [i for i in begins if i == 0 or i + 1 < len(lines)]
    if not lines:
        return []
    return [(b - a, lines[a][1]) for a, b in zip(begins, [*begins[1:], len(lines)], strict=True)]


def texts(rng, n):
    words = lambda: " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 4)))
    return ["\n".join(rng.choice([words(), words(), "", "same line"]) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_chunks_match_a_plain_reading_and_no_neighbour_matters():
    made = texts(random.Random(1), 200) + ["", "\n\n", "one", "é\nü\n" * 5]
    owner, number, count, start, end, h = line_dedup.line_chunks(pa.array(made))
    offsets = textops.buffers(pa.array(made))[1]
    for i, text in enumerate(made):
        mine = owner == i
        got = list(zip(count[mine].tolist(), (start[mine] - offsets[i]).tolist(), strict=True))
        assert got == plain_chunks(text), i
        alone = line_dedup.line_chunks(pa.array([text]))
        assert alone[2].tolist() == count[mine].tolist() and alone[5].tolist() == h[mine].tolist()


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    blocks = texts(rng, 12)
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(rng.randrange(4))] + [rng.choice(blocks)] + [f"end {i}"])) for i in range(150)] + [(5, blocks[0]), (5, blocks[1]), (None, blocks[0]), (200, None), (201, "long line\n" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as h", "3 as c1")
    one, nine = (sorted(map(tuple, line_dedup.repeated_chunks(x).collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert one == nine and one
    found = line_dedup.repeated_chunks(df)
    out = line_dedup.remove_chunks(df, found)
    assert out.columns == df.columns and out.where("spans = 1 and h = 2 and c1 = 3").count() == len(rows)
    left = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] not in (None, 5)}
    assert left[200] is None and left[201] == "long line\n" * 60_000 and all(left[i].endswith(f"end {i}") for i in range(5))


def test_blocks_in_mid_text_lose_most_of_their_lines(spark):
    """What the method finds of repeated blocks by their size: figures of the README."""
    rng = random.Random(3)
    line = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(5))
    share = {}
    for size in (4, 8, 20):
        rows, total = [], 0
        for p in range(60):
            block = [line() for _ in range(size)]
            total += size
            for side in (0, 1):
                rows.append((2 * p + side, "\n".join([line() for _ in range(6)] + block + [line() for _ in range(6)])))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        share[size] = line_dedup.line_summary(df, line_dedup.repeated_chunks(df)).agg({"n_removed_lines": "sum"}).first()[0] / total
    assert share[4] < share[8] < share[20] and share[20] > 0.7, share
