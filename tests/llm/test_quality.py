import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wardlight.llm import quality, textops

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            marked.update((i, i + 1, i + 2))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(marked), "dup_line_chars": dup_chars}
    for n in quality.NGRAM_LIMITS:
        met, inside = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in met:
                inside.update(range(i, i + n))
            met.add(gram)
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside)
    return out


CASES = [None, "", " \n\t", "a", "a b", "a b c a b c", "x\nx\n\n \n \nx ", "é é é é é é é é é é é é", "a b c d e f g h i j " * 9, "w" * 200_000, ("q " * 150_000), "same line here\nsame line here\nsame line here\n"]


@pytest.mark.parametrize("piece", [1 << 20, 61])
def test_measures_match_brute_force(piece, monkeypatch):
    monkeypatch.setattr(textops, "PIECE", piece)
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:120]
    texts = CASES + real if piece > 100 else CASES[:9] + real[:10]
    got = quality.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        for name, value in brute(text).items():
            assert got[name][i] == value, (i, name)


def test_query_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 60, None), (3, "word " * 60, None), (None, " ".join(f"w{i}" for i in range(80)), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality.repetition_quality(df).collect()}
    assert got == {(1, 0, True, False), (2, 0, True, False), (3, 60, True, False), (None, 80, False, True)}
    assert quality.repetition_quality(df.limit(0)).count() == 0
