"""Quality rules from repetition: how much of a text stands inside n-grams and lines that it has used before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

#: Largest share of a text's word characters inside repeated runs of n words (later occurrences only), and in repeated lines. Fixed values from published rules for web text.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of these are not the first with their value."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    every, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    if len(twice):
        table = np.zeros(1 << 20, dtype=bool)
        table[twice >> np.uint64(44)] = True
        maybe = np.flatnonzero(table[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
        real = twice[at] == keys[maybe]
        maybe, at = maybe[real], at[real]
        every[maybe] = True
        first = np.full(len(twice), len(keys), dtype=np.int64)
        np.minimum.at(first, at, maybe)
        later[maybe[maybe != first[at]]] = True
    return every, later


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the runs of ``size`` places from ``starts``."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of an Arrow column."""
    data, offsets = textops.buffers(texts)
    w = textops.words(data, offsets, textops.VISIBLE, False)
    lines = textops.words(data, offsets, _NOT_NEWLINE, False)
    n_texts, n = len(texts), len(w.hash)
    inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
    chars = w.end - w.start - (np.searchsorted(inner, w.end) - np.searchsorted(inner, w.start))
    owner = np.repeat(np.arange(n_texts), np.diff(w.first))
    salt = textops.mix(np.arange(n_texts, dtype=np.uint64) + np.uint64(1))
    per_text = lambda values, of: np.bincount(of, weights=values, minlength=n_texts).astype(np.int64)
    out = {"n_words": np.diff(w.first), "word_chars": per_text(chars, owner)}
    symbols = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = np.diff(np.searchsorted(symbols, offsets))

    line_owner = np.repeat(np.arange(n_texts), np.diff(lines.first))
    inside = np.searchsorted(w.start, lines.end) - np.searchsorted(w.start, lines.start)
    _, again = repeated(lines.hash ^ salt[line_owner])
    again &= inside > 0
    out["n_dup_lines"] = per_text(again, line_owner)
    sums = np.concatenate([[0], np.cumsum(chars)])
    first_word = np.searchsorted(w.start, lines.start)
    out["dup_line_chars"] = per_text(np.where(again, sums[first_word + inside] - sums[first_word], 0), line_owner)

    last = w.first[1:][owner]
    rolling = np.zeros(n, dtype=np.uint64)
    for size in range(1, max(NGRAM_LIMITS) + 1):  # the hash of a run grows by one word a step
        if n < size:
            rolling = np.zeros(0, dtype=np.uint64)
        else:
            rolling = (rolling[: n - size + 1] ^ w.hash[size - 1 :]) * np.uint64(0xD6E8FEB86659FD93)
            rolling ^= rolling >> np.uint64(32)
        if size != 3 and size not in NGRAM_LIMITS:
            continue
        whole = np.flatnonzero(np.arange(len(rolling)) + size <= last[: len(rolling)])
        every, later = repeated(textops.mix(rolling[whole]) ^ salt[owner[whole]])
        if size == 3:
            out["n_repeat_words"] = per_text(covered(whole[every], 3, n), owner)
        if size in NGRAM_LIMITS:
            out[f"dup_chars_{size}"] = per_text(np.where(covered(whole[later], size, n), chars, 0), owner)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_LIMITS)]


def repetition_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each row of docs, from its whole text.

    Texts are measured in groups of some megabytes with numpy. Words are runs of what isn't white space. A run of n
    words is found again by its rolling hash; characters under later occurrences, for n from 5 to 10, and characters of
    lines equal to an earlier one, are set against all word characters. ``base_failed``: fewer than 50 words, or over
    half of all words in 3-word runs that occur twice or more. ``kept``: not so, and no share above its limit.

    A null or empty text has no words and fails; repeated rows are judged alike; a text of any length is measured whole, in
    memory of some hundred bytes a word; an empty table gives an empty result; further columns are ignored.
    """
    names = ["doc_id", *_COUNTS]

    def run(batches):
        for batch in batches:
            for a, b in textops.groups(batch.column(1)):
                found = measure(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *(pa.array(found[c].astype(np.int64)) for c in _COUNTS)], names)

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, most in NGRAM_LIMITS.items():
        fine = fine & (F.col(f"dup_chars_{n}") <= most * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
