"""Line dedup over content-defined chunks of lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .columns import Given
from .store import Scratch

_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def line_chunks(texts: pa.Array):
    """Chunks of consecutive lines: (text index, number in its text, lines, first byte, end byte, hash).

    A chunk starts with a text, and at each line whose rolling hash over itself and the next line is less than those of
    both neighbours; the last line of a text has the greatest hash, whatever text comes next. This looks two lines ahead
    and one back only, so chunks fall alike wherever the same lines stand, and have two lines at least but for the last
    and first of a text. Empty lines go with the line before.
    """
    data, offsets = textops.buffers(texts)
    lines = textops.words(data, offsets, _LINE, False)
    n = len(lines.hash)
    if not n:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5)) + (np.zeros(0, dtype=np.uint64),)
    top = np.iinfo(np.uint64).max
    last = np.zeros(n + 1, dtype=bool)
    last[lines.first[1:] - 1] = True  # of its text; the place before the first line is no line
    key = np.full(n + 2, top, dtype=np.uint64)
    key[1:n] = np.where(last[: n - 1], top, textops.shingles(lines.hash, 2))
    begins = (key[1:-1] < key[:-2]) & (key[1:-1] < key[2:])
    begins[lines.first[:-1][np.diff(lines.first) > 0]] = True
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, n))
    owner = np.searchsorted(lines.first, at, side="right") - 1
    number = np.arange(len(at)) - np.searchsorted(at, lines.first[owner])
    h = textops.mix(np.add.reduceat(textops.mix(lines.hash + np.arange(n, dtype=np.uint64) - np.repeat(at, count).astype(np.uint64)), at) + count.astype(np.uint64))
    return owner, number, count, lines.start[at], lines.end[at + count - 1], h


def _chunk_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b in textops.groups(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                owner, number, count, start, end, h = line_chunks(texts)
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                offsets = textops.buffers(texts)[1]
                columns = (ids[owner], number, count, start - offsets[owner], end - start, h.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "chunk", "n_lines", "start", "n_bytes", "h"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk long, n_lines long, start long, n_bytes long, h long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, n_lines, start, n_bytes, h): multi-line chunks whose bytes stand in an earlier place, by doc_id and position.

    Chunks are grouped by hash and length with partial sums before the shuffle. Of repeated ones the bytes are fetched
    and compared with those of the first place, by an equi-join on the hash; only equal ones are returned.

    A null or empty text and a row without doc_id have no chunks; a single repeated line is no multi-line chunk and
    stays; repeated rows with one doc_id repeat nothing by that, and where their texts differ h tells which of them has the
    chunk; a text of any length is read whole; an empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select("doc_id", "text")
    chunks = scratch.keep(_chunk_rows(docs).where("n_lines > 1").distinct())
    place = F.struct("doc_id", "chunk", "start")
    first = chunks.groupBy("h", "n_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "n_bytes", "first")
    again = chunks.join(first, ["h", "n_bytes"])
    places = again.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "n_lines", "start", "n_bytes", "h", (place == F.col("first")).alias("is_first"))).alias("places"))
    fields = "doc_id long, chunk long, n_lines long, start long, n_bytes long, h long, is_first boolean, bytes binary"

    def fetch(batches):
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, there = text.as_buffer(), _chunks_of(text.as_py())
                rows = [(doc, p["chunk"], p["n_lines"], p["start"], p["n_bytes"], p["h"], p["is_first"], raw.slice(p["start"], p["n_bytes"]).to_pybytes()) for p in places if (p["start"], p["n_bytes"], p["h"]) in there]
                kinds = (*[pa.int64()] * 6, pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "chunk", "n_lines", "start", "n_bytes", "h", "is_first", "bytes"])

    fetched = scratch.keep(docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(fetch, fields))
    models = fetched.where("is_first").select("h", "n_bytes", F.col("bytes").alias("model")).dropDuplicates(["h", "n_bytes"])
    same = fetched.where("not is_first").join(models, ["h", "n_bytes"]).where(F.col("bytes") == F.col("model"))
    result = scratch.keep(same.select("doc_id", "chunk", "n_lines", "start", "n_bytes", "h").distinct())
    scratch.drop(chunks, fetched)
    return result


def _chunks_of(text: str) -> set[tuple[int, int, int]]:
    """(start, bytes, hash) of each chunk of a text."""
    _, _, _, start, end, h = line_chunks(pa.array([text], pa.string()))
    return set(zip(start.tolist(), (end - start).tolist(), h.view(np.int64).tolist(), strict=True))


def line_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed_lines, n_bytes, n_removed_bytes) for each row of docs, empty lines not counted.

    A null or empty text has no lines; a null doc_id has no chunks; rows that repeat a doc_id are each counted against
    all chunks of that id; an empty table gives an empty result; further columns are ignored.
    """
    cut = chunks.groupBy(F.col("doc_id").alias("cut")).agg(F.sum("n_lines").alias("cut_lines"), F.sum("n_bytes").alias("cut_bytes"))
    lines = F.coalesce(F.regexp_count("text", F.lit(r"[^\n]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", lines.alias("n_lines"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.join(cut, F.col("doc_id") == F.col("cut"), "left")
    return out.select("doc_id", "n_lines", F.coalesce("cut_lines", F.lit(0)).alias("n_removed_lines"), "n_bytes", F.coalesce("cut_bytes", F.lit(0)).alias("n_removed_bytes"))


def remove_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with these chunks cut from text; the line ends that follow a chunk go with it.

    A chunk is cut only from a text that has it in that place; a null text stays null; a document without chunks and a row
    without doc_id stay as they are; an empty table gives an empty result; further columns of any name are kept.
    """
    given = Given(docs)
    rest = given.kept("text")
    named = [*rest, given.of("text")]

    def run(batches):
        for batch in batches:
            out = []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and places:
                    raw, parts, at, there = text.encode(), [], 0, _chunks_of(text)
                    for p in sorted(places, key=lambda p: p["start"]):
                        if (p["start"], p["n_bytes"], p["h"]) not in there:
                            continue
                        parts.append(raw[at : p["start"]])
                        at = p["start"] + p["n_bytes"]
                        while at < len(raw) and raw[at] == 0x0A:
                            at += 1
                    text = b"".join([*parts, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(out, pa.string())], named)

    spans = chunks.groupBy(F.col("doc_id").alias("cut")).agg(F.collect_list(F.struct("start", "n_bytes", "h")).alias("spans"))
    joined = given.table.join(spans, given["doc_id"] == F.col("cut"), "left").select(given.of("text"), "spans", *rest)
    return given.back(joined.mapInArrow(run, given.table.select(*rest, given.of("text")).schema))
