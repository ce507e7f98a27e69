"""Benchmark decontamination with a positional inverted index of the training texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .store import Scratch

WINDOW = 10
#: Free positions between texts, so that no phrase spans two of them.
GAP = 1 << 10
#: Bytes of text in a segment of the index, of benchmark text that is asked in one turn, and of its windows at most; candidates that are held at once.
SEGMENT, ITEMS_AT_ONCE, MOST_BYTES, CANDIDATES = 1 << 22, 1 << 21, 1 << 28, 1 << 18
#: Bytes of a piece of an item; a longer item is asked in pieces that overlap by a window less one word.
PIECE = 1 << 17


class Segment:
    """The index of some texts: for each term the sorted positions at which it stands, over all texts of the segment."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.terms, self.ends, self.positions = terms, ends, positions
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), ends - self.begins) << 40 | positions.astype(np.int64)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this segment, -1 where it doesn't occur."""
        if not len(self.terms):
            return np.full(len(terms), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def at(self, term: np.ndarray, position: np.ndarray, slop: int = 0) -> np.ndarray:
        """Whether the term stands at this position, or within slop of it."""
        low = np.searchsorted(self.keys, (term << 40) | np.maximum(position - slop, 0))
        found = self.keys[np.minimum(low, len(self.keys) - 1)]
        return (position + slop >= 0) & (found >= (term << 40 | np.maximum(position - slop, 0))) & (found <= (term << 40 | np.maximum(position + slop, 0)))


def phrase_starts(segment: Segment, windows: np.ndarray, lengths: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start): all places where a window's terms stand in a row. windows: term hashes, one row a window.

    For each window the postings of its rarest term give the candidates; the lists of the other terms, from rare to
    frequent, are intersected with them at the right offset. With ``slop``, a term may be that far from its place.
    Windows are taken in blocks of about CANDIDATES postings, so a frequent term costs time and no memory.
    """
    n, width = windows.shape
    number = np.where(np.arange(width) < lengths[:, None], segment.find(windows.ravel()).reshape(n, width), -2)
    alive = np.flatnonzero(~(number == -1).any(axis=1))
    if not len(alive) or not len(segment.terms):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    number = number[alive]
    sizes = segment.ends - segment.begins
    count = np.where(number >= 0, sizes[np.maximum(number, 0)], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    rarest = number[np.arange(len(alive)), order[:, 0]]
    many = sizes[rarest]
    ahead = np.cumsum(many)
    found, low = [], 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(ahead, (ahead[low - 1] if low else 0) + CANDIDATES, side="right")))
        window = np.repeat(np.arange(low, high), many[low:high])
        inner = np.arange(len(window)) - np.repeat(np.cumsum(many[low:high]) - many[low:high], many[low:high])
        start = segment.positions[segment.begins[rarest][window] + inner].astype(np.int64) - order[window, 0]
        for k in range(1, width):
            if not len(window):
                break
            offset = order[window, k]
            term = number[window, offset]
            good = term < 0
            good[~good] = segment.at(term[~good], start[~good] + offset[~good], slop)
            window, start = window[good], start[good]
        found.append((alive[window], start))
        low = high
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def item_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of the items as rows of term hashes, their lengths, and pairs (window, number of an item that has it)."""
    data, offsets = textops.buffers(texts)
    w = textops.words(data, offsets, textops.ALNUM, True)
    size = np.diff(w.first)
    each = np.where(size > 0, np.maximum(size - WINDOW + 1, 1), 0)
    item = np.repeat(np.arange(len(size)), each)
    start = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
    place = start[:, None] + np.arange(WINDOW)
    inside = place < w.first[1:][item][:, None]
    rows = np.where(inside, w.hash[np.minimum(place, max(0, len(w.hash) - 1))], np.uint64(0)) if len(item) else np.zeros((0, WINDOW), dtype=np.uint64)
    lengths = inside.sum(axis=1).astype(np.int64)
    table, window = np.unique(np.concatenate([rows, lengths[:, None].astype(np.uint64)], axis=1), axis=0, return_inverse=True)
    owners = np.unique(np.stack([window.ravel(), item], axis=1), axis=0)
    return np.ascontiguousarray(table[:, :WINDOW]), table[:, WINDOW].astype(np.int64), owners[:, 0], owners[:, 1]


_INDEX = "segment string, doc_ids array<long>, n_words array<int>, terms binary, ends binary, steps binary"


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each segment: its texts, and the positional postings of all their terms. It serves any benchmark."""

    def segments(batches):
        made, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for a, b in textops.groups(batch.column(1), SEGMENT):
                data, offsets = textops.buffers(batch.column(1).slice(a, b - a))
                w = textops.words(data, offsets, textops.ALNUM, True)
                each = np.diff(w.first)
                place = np.arange(len(w.hash)) + np.repeat(np.arange(len(each)) * GAP, each)
                order = np.argsort(w.hash, kind="stable")
                term = w.hash[order]
                ends = np.flatnonzero(np.append(term[1:] != term[:-1], True)) if len(term) else np.zeros(0, dtype=np.int64)
                blobs = term[ends], (ends + 1).astype(np.int64), np.diff(place[order], prepend=0).astype(np.int32)
                row = [f"{task}-{made}"], [batch.column(0).slice(a, b - a).to_pylist()], [each.astype(np.int32).tolist()], *([x.tobytes()] for x in blobs)
                made += 1
                kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["segment", "doc_ids", "n_words", "terms", "ends", "steps"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(segments, _INDEX)


_HITS = "segment string, place int, doc_id long, n_words long, items array<string>, spans array<struct<start:long,n_words:long>>"


def search(index: DataFrame, ids: list[str], texts: pa.Array, slop: int = 0) -> DataFrame:
    """For each text of the index: its place there, doc_id and n_words, the items with occurring windows, and the spans of these.

    The windows go to all tasks; they may have MOST_BYTES at most.
    """
    asked = item_windows(texts)
    if sum(x.nbytes for x in asked) > MOST_BYTES:
        raise ValueError("too many windows for one turn: ask in more turns")
    sent = index.sparkSession.sparkContext.broadcast((ids, *asked))
    span = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), span)

    def run(batches):
        ids, windows, lengths, owner, item = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                name, docs, each = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), np.array(batch.column(2)[r].as_py(), dtype=np.int64)
                terms, ends, steps = (np.frombuffer(batch.column(3 + k)[r].as_buffer(), dtype=t) for k, t in enumerate((np.uint64, np.int64, np.int32)))
                window, start = phrase_starts(Segment(terms, ends, np.cumsum(steps, dtype=np.int64)), windows, lengths, slop)
                base = np.concatenate([[0], np.cumsum(each)[:-1]]) + np.arange(len(each)) * GAP
                doc = np.searchsorted(base, start, side="right") - 1
                items: list[list] = [[] for _ in docs]
                spans: list[list] = [[] for _ in docs]
                low, high = np.searchsorted(owner, window), np.searchsorted(owner, window, side="right")
                mine = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(int((high - low).sum()))
                for d, k in np.unique(np.stack([np.repeat(doc, high - low), item[mine]], axis=1), axis=0).tolist():
                    items[d].append(ids[k])
                for d, s, n in np.unique(np.stack([doc, start - base[doc], lengths[window]], axis=1), axis=0).tolist():
                    spans[d].append({"start": s, "n_words": n})
                columns = [name] * len(docs), range(len(docs)), docs, each, [sorted(set(x)) for x in items], spans
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["segment", "place", "doc_id", "n_words", "items", "spans"])

    return index.mapInArrow(run, _HITS)


def covered(spans: Column) -> Column:
    """How many words stand in at least one of the spans."""

    def add(done: Column, s: Column) -> Column:
        end = s["start"] + s["n_words"]
        return F.struct((done["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], done["end"]))).alias("n"), F.greatest(done["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), add, lambda done: done["n"])


def _pieces(items: DataFrame) -> DataFrame:
    """(item_id, text): long items cut between words, so that each of their windows stands whole in exactly one piece."""
    most = PIECE

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                if len(raw) <= most:
                    ids.append(item)
                    texts.append(raw)
                    continue
                data = np.frombuffer(raw, dtype=np.uint8)
                w = textops.words(data, np.array([0, len(data)]), textops.ALNUM, True)
                begin, n = 0, len(w.start)
                while begin == 0 and n or begin + WINDOW <= n:
                    end = min(n, max(begin + WINDOW, int(np.searchsorted(w.end, w.start[begin] + most, side="right"))))
                    ids.append(item)
                    texts.append(raw[w.start[begin] : w.end[end - 1]])
                    begin = end - WINDOW + 1 if end < n else n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["item_id", "text"])

    return items.mapInArrow(cut, "item_id string, text string")


def find_contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of docs: which benchmark windows stand where in its text.

    Windows are 10 consecutive words of an item, or all of them if it has fewer. The postings of the training texts are
    written to the shared folder, one row for each segment of texts; each segment then answers all windows. Nothing is
    shuffled, and a text of any length is indexed whole. ``slop`` above 0 gives proximity matches: each word of a window
    stands within that distance of its place.

    A null or empty text has no words and no hit, and so has an item; a null item_id is left out; repeated rows are
    answered one by one, and so are repeated items; an empty table on either side gives no hits; further columns are
    ignored. The benchmark is asked in turns of about ITEMS_AT_ONCE bytes over the same index, and the driver holds one
    turn at a time; an item of any length is asked in pieces, so no turn outgrows MOST_BYTES.
    """
    scratch = Scratch(docs.sparkSession, "index")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = -(-total // ITEMS_AT_ONCE) or 1
    index = scratch.keep(build_index(docs))
    items = _pieces(items)
    answers = []
    for k in range(turns):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == k).toArrow()
        asked = search(index, table["item_id"].to_pylist(), table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()), slop)
        answers.append(asked if turns == 1 else scratch.keep(asked.where(F.size("items") > 0).select("segment", "place", "items", "spans")) if k else scratch.keep(asked))
    out = answers[0]
    if turns > 1:
        more = reduce(DataFrame.unionByName, answers[1:]).groupBy("segment", "place").agg(F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans"))
        joined = out.join(more, ["segment", "place"], "left")
        both = lambda a, b: F.array_sort(F.array_distinct(F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))))
        out = joined.select("doc_id", "n_words", both("items", "more_items").alias("items"), both("spans", "more_spans").alias("spans"))
    return out.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items", "spans")
