"""Substring dedup: paragraphs and passages that repeat across documents, by MinHash bands, exact checks and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .cells import join_cells
from .columns import Given
from .components import connected_components
from .store import Scratch, filtered_scans

#: Words of a shingle, least Jaccard similarity, and minima of a band.
SHINGLE, THRESHOLD, ROWS = 5, 0.8, 2
#: Words of the shortest line that is a paragraph, and of a passage; of so many starts in a row one is chosen at least.
LEAST = 20
_ALL = (1 << 64) - 1
#: Bits of a key. A key only brings units together, whose contents are then compared, so keys that meet by chance cost a comparison
#: and change no result; the low 16 bits are zeros, which the shuffle compresses away.
KEY = np.uint64(_ALL - 0xFFFF)


def _starts(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first least pair of every LEAST starts in a row, in each text; a text of fewer starts has one."""
    begin, room = first[:-1], np.diff(first) - LEAST + 1
    full, short = np.flatnonzero(room >= LEAST), np.flatnonzero((room > 0) & (room < LEAST))
    at = [np.zeros(0, dtype=np.int64)]
    if len(full):
        windows = np.lib.stride_tricks.sliding_window_view(pair, LEAST)
        count = room[full] - LEAST + 1
        where = np.repeat(begin[full] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        for k in range(0, len(where), 1 << 20):
            part = where[k : k + (1 << 20)]
            at.append(part + windows[part].argmin(axis=1))
    at.append(np.array([begin[i] + pair[begin[i] : begin[i] + room[i]].argmin() for i in short.tolist()], dtype=np.int64))
    return np.unique(np.concatenate(at))


def units(texts: pa.Array):
    """Paragraphs and passages: (text index, first word, number of words, is a line), and the words.

    A paragraph is a line of LEAST words or more. Passages are LEAST words from each content-chosen start in the word
    sequence of any text, whatever its line ends: every run of 2 * LEAST words that two texts share, and every whole
    text of LEAST words that they share, holds a passage of both.
    """
    data, offsets = textops.buffers(texts)
    w = textops.words(data, offsets, textops.VISIBLE, True)
    n = len(w.hash)
    line = np.searchsorted(np.flatnonzero(data == 0x0A), w.start)
    new = np.ones(n, dtype=bool)
    new[1:] = line[1:] != line[:-1]
    new[w.first[:-1][w.first[:-1] < n]] = True
    line_at = np.flatnonzero(new)
    line_n = np.diff(np.append(line_at, n))
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    good = line_n >= LEAST
    at = _starts(textops.shingles(w.hash, 2), w.first) if n else np.zeros(0, dtype=np.int64)
    first = np.concatenate([line_at[good], at])
    count = np.concatenate([line_n[good], np.full(len(at), LEAST)])
    return owner[first], first - w.first[owner[first]], count, np.arange(len(first)) < good.sum(), first, w


def tune_bands(threshold: float, rows: int = 2, miss: float = 0.003) -> int:
    """How many bands of ``rows`` minima leave at most ``miss`` of the pairs at the threshold without a common band."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def contents(runs: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the content, places of its shingles, where they begin) of units of count words each from word ``first``."""
    size = count - SHINGLE + 1
    edges = np.cumsum(size) - size
    at = np.repeat(first - edges, size) + np.arange(int(size.sum()))
    return textops.mix(np.add.reduceat(textops.mix(runs[at]), edges) + count.astype(np.uint64)), at, edges


def band_keys(runs: np.ndarray, at: np.ndarray, edges: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (units, bands): each names the minima of the unit's shingles in ``rows`` orders."""
    out = np.zeros((len(edges), bands), dtype=np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(textops.mix(runs ^ np.uint64(0xA0761D6478BD642F * (k + 1) & _ALL))[at], edges)
        out[:, k // rows] = textops.mix(out[:, k // rows] ^ least) + np.uint64(k // rows)
    return out


def run_keys(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (passages, 2) of all shingles but the last and but the first, and which passages have no shingle twice.

    Of two passages without repeated shingles that reach 0.8 together, each lacks at most one shingle of the other, its
    first or its last; so they agree in one of these keys.
    """
    parts = [textops.mix(contents(runs, first + k, np.full(len(first), LEAST - 1))[0] + np.uint64(1)) for k in (0, 1)]
    ordered = np.sort(runs[first[:, None] + np.arange(LEAST - SHINGLE + 1)], axis=1)
    return np.stack(parts, axis=1), (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)


def signatures(docs: DataFrame, threshold: float) -> DataFrame:
    """(key, h, doc_id, start, n_words): rows of each unit, one a key; h names the content.

    A paragraph has a key for each band, and so has a passage that repeats a shingle; any other passage has its two run keys.
    """
    bands = tune_bands(threshold, ROWS)

    def run(batches):
        for batch in batches:
            for a, b in textops.groups(batch.column(1)):
                owner, start, count, is_line, first, w = units(batch.column(1).slice(a, b - a))
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                runs = textops.shingles(w.hash, SHINGLE)
                passages = np.flatnonzero(~is_line)
                ends, plain = run_keys(runs, first[passages]) if len(passages) else (None, np.zeros(0, dtype=bool))
                plain &= threshold > (LEAST - SHINGLE - 1) / (LEAST - SHINGLE + 3)  # so near that two lacking shingles are too many
                for mine, keys in ((passages[plain], ends[plain] if len(passages) else None), (np.concatenate([np.flatnonzero(is_line), passages[~plain]]), None)):
                    if not len(mine):
                        continue
                    h, at, edges = contents(runs, first[mine], count[mine])
                    keys = (band_keys(runs, at, edges, bands, ROWS) if keys is None else keys) & KEY
                    repeat = lambda x, t: pa.array(np.repeat(x, keys.shape[1]), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), repeat(h.view(np.int64), pa.int64()), repeat(ids[owner[mine]], pa.int64()), repeat(start[mine], pa.int32()), repeat(count[mine], pa.int32())], ["key", "h", "doc_id", "start", "n_words"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, h long, doc_id long, start int, n_words int")


def _shingle_rows(docs: DataFrame) -> DataFrame:
    """(h, shingles) of the places (h, start, n_words) listed with each text, as far as the text has that content there."""

    def run(batches):
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, offsets = textops.buffers(pa.array([text.as_py()], pa.string()))
                runs = textops.shingles(textops.words(data, offsets, textops.VISIBLE, True).hash, SHINGLE)
                whole = [p for p in places if p["start"] + p["n_words"] - SHINGLE < len(runs)]
                found = [contents(runs, np.array([p["start"]]), np.array([p["n_words"]]))[0].view(np.int64)[0] for p in whole]
                kept = [p for p, h in zip(whole, found, strict=True) if p["h"] == h]
                sets = [np.unique(runs.view(np.int64)[p["start"] : p["start"] + p["n_words"] - SHINGLE + 1]) for p in kept]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([p["h"] for p in kept], pa.int64()), lists], ["h", "shingles"])

    return docs.mapInArrow(run, "h long, shingles array<long>")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, cluster, start, n_words, h, removed): each paragraph or passage that other documents have too.

    Equal content is settled by its hash. Paragraphs of unequal content meet where a MinHash band agrees; the bands are
    tuned for the threshold. All contents of a band are compared with one of them, by the exact Jaccard similarity of their
    5-word shingles; what is then in different components is joined exactly within the band, so no two that meet stay
    uncompared. Passages meet by what they have in common at 0.8. Components over these links are the clusters; a cluster within one
    document is left alone. The first place of a cluster, by doc_id and position, stays, the others are to be removed.

    A null or empty text, a text of fewer than 20 words and a row without doc_id have no units; rows with one doc_id are
    one document, and h tells whose text has a passage; a text of any length is read whole; an empty table gives an empty
    result; further columns are ignored.
    """
    percent = round(100 * threshold)
    scratch = Scratch(docs.sparkSession, "passages")
    docs = docs.select("doc_id", "text")
    found = signatures(docs, threshold)
    keys = scratch.keep(found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"))
    scratch.sweep()
    rows = scratch.keep(found.join(keys.hint("shuffle_hash"), "key"))
    scratch.drop(keys)
    scratch.sweep()
    several = rows.groupBy("key").agg(F.min("h").alias("head"), F.max("h").alias("hi")).where("head < hi").select("key", "head")
    met = scratch.keep(rows.join(several, "key").groupBy("key", "head", "h").agg(F.min(F.struct("doc_id", "start", "n_words")).alias("x")))
    places = scratch.keep(met.groupBy("h").agg(F.min("x").alias("x")).groupBy("x.doc_id").agg(F.collect_list(F.struct("h", "x.start", "x.n_words")).alias("places")))
    with filtered_scans(docs.sparkSession):  # texts without such a place aren't shuffled
        sets = scratch.keep(_shingle_rows(docs.join(places.where("doc_id >= -9223372036854775807 or doc_id <= 0"), "doc_id").select("text", "places")).dropDuplicates(["h"]))
    scratch.drop(places)
    scratch.sweep()
    pairs = met.where("h <> head").select("h", "head").distinct()
    checked = pairs.join(sets, "h").join(sets.select(F.col("h").alias("head"), F.col("shingles").alias("others")), "head")
    both = F.size(F.array_intersect("shingles", "others"))
    links = scratch.keep(checked.where(100 * both >= percent * (F.size("shingles") + F.size("others") - both)).select(F.col("h").alias("a"), F.col("head").alias("b")))
    joined = scratch.keep(connected_components(links, scratch))
    scratch.sweep()
    named = met.join(joined.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("component", "h").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("c1"), F.max("label").alias("c2")).where("c1 < c2").select("key")
    cells = named.join(mixed, "key").join(sets, "h").select(F.hex("key").alias("cell"), F.col("h").alias("id"), F.size("shingles").cast("long").alias("n"), "label", F.col("shingles").alias("tokens"))
    links = links.unionByName(join_cells(scratch.keep(cells), percent, scratch))
    groups = scratch.keep(connected_components(scratch.keep(links), scratch))
    spots = rows.select("h", "doc_id", "start", "n_words").distinct().join(groups.withColumnRenamed("node", "h"), "h", "left").select("doc_id", "start", "n_words", "h", F.coalesce("component", "h").alias("cluster"))
    spots = scratch.keep(spots)
    first = spots.groupBy("cluster").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("hi")).where(F.col("first.doc_id") < F.col("hi")).select("cluster", "first")
    out = spots.join(first, "cluster").select("doc_id", "cluster", "start", "n_words", "h", (F.struct("doc_id", "start") != F.col("first")).alias("removed"))
    result = scratch.keep(out)
    scratch.drop(*[t for t in scratch.held if t is not result])
    scratch.sweep()
    return result


def by_document(passages: DataFrame) -> DataFrame:
    """(doc_id, n_passages, n_clusters, n_repeated_words, n_removed_words): words are counted once however many passages overlap on them.

    An empty table gives an empty result; a document without passages has no row; further columns are ignored.
    """
    before = Window.partitionBy("doc_id").orderBy("start", "n_words", "cluster", "removed").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n_words")
    new = lambda seen: F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(seen).over(before), F.lit(0))))
    cut = F.when(F.col("removed"), end)
    spans = passages.select("doc_id", "cluster", "start", "n_words", "removed", new(end).alias("all"), F.when(F.col("removed"), new(cut)).otherwise(0).alias("gone"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_passages"), F.countDistinct("cluster").alias("n_clusters"), F.sum("all").cast("long").alias("n_repeated_words"), F.sum("gone").cast("long").alias("n_removed_words"))


def every_document(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The columns of by_document for each doc_id of docs, zeros where it has no row; ids that repeat are one document, and rows without doc_id have none."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    numbers = [c for c in counts.columns if c != "doc_id"]
    return ids.join(counts, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers))


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the words of removed passages cut from text; white space before a cut word goes with it.

    A passage is cut only where the text has its content; a null text stays null; a document without passages and a row without
    doc_id stay as they are; repeated rows are cut alike; further columns of any name are kept.
    """

    given = Given(docs)
    rest = given.kept("text")
    named = [*rest, given.of("text")]

    def run(batches):
        for batch in batches:
            texts, out = batch.column(0), []
            for text, spans in zip(texts.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and spans:
                    data, offsets = textops.buffers(pa.array([text], pa.string()))
                    w = textops.words(data, offsets, textops.VISIBLE, True)
                    runs = textops.shingles(w.hash, SHINGLE)
                    keep = np.ones(len(data), dtype=bool)
                    for s in spans:
                        a, b = s["start"], s["start"] + s["n_words"]
                        if b <= len(w.start) and contents(runs, np.array([a]), np.array([b - a]))[0].view(np.int64)[0] == s["h"]:
                            keep[(w.end[a - 1] if a else 0) : w.end[b - 1]] = False
                    text = data[keep].tobytes().decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(out, pa.string())], named)

    spans = passages.where("removed").groupBy(F.col("doc_id").alias("cut")).agg(F.collect_set(F.struct("start", "n_words", "h")).alias("spans"))
    joined = given.table.join(spans, given["doc_id"] == F.col("cut"), "left").select(given.of("text"), "spans", *rest)
    return given.back(joined.mapInArrow(run, given.table.select(*rest, given.of("text")).schema))
