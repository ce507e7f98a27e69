"""How five quality filters act together: what each removes, first or again, in every order in which they can be applied."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .columns import Given
from .store import Scratch

FILTERS = "ABCDE"
#: The limits of the filters A to C, and the symbols of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The place of each filter in each order, from 1.
PLACE = np.array([[order.index(f) + 1 for order in ORDERS] for f in FILTERS])
MASKS, STEPS, LABELS = 1 << len(FILTERS), len(FILTERS) + 1, 4
#: The step at which a text that fails these filters (bits of the row) goes in that order (column); 0 if it stays.
FIRST = np.array([np.min(np.where([[mask >> k & 1] for k in range(len(FILTERS))], PLACE, STEPS), axis=0) % STEPS for mask in range(MASKS)])
#: Cells of the partial array of a part: steps by order and label, and behind them the masks.
CELLS = len(ORDERS) * STEPS * LABELS + MASKS
#: Parts whose arrays a task holds at once.
PARTS = 256

_table = lambda of: np.isin(np.arange(256), np.frombuffer(of, dtype=np.uint8))
_SYMBOL, _CAPITAL = _table(SYMBOLS), _table(bytes(range(0x41, 0x5B)))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def failures(texts: pa.Array) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits."""
    data, offsets = textops.buffers(texts)
    w = textops.words(data, offsets, textops.VISIBLE, False)
    n = np.diff(w.first)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((w.hash, owner))
    mine, of = w.hash[order], owner[order]
    fresh = np.ones(len(mine), dtype=bool)
    fresh[1:] = (mine[1:] != mine[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[fresh], minlength=len(texts))
    capitals, points = textops.counts(_CAPITAL[data], offsets), textops.counts(_LEAD[data], offsets)
    found = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, textops.counts(_SYMBOL[data], offsets) > 0]
    return sum(f.astype(np.int64) << k for k, f in enumerate(found))


def removals(masks: np.ndarray, labels: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The partial array of some rows of a part: how many with each label go at each step of each order, and how many fail just these filters."""
    classes = np.zeros(MASKS * LABELS, dtype=np.int64)
    np.add.at(classes, masks * LABELS + labels, times)
    seen = np.flatnonzero(classes)
    cell = (np.arange(len(ORDERS)) * STEPS + FIRST[seen // LABELS]) * LABELS + (seen % LABELS)[:, None]
    out = np.zeros(CELLS, dtype=np.int64)
    weight = classes[seen]
    for low in range(0, 63, 31):  # bincount adds doubles: 31 bits at a time keep every sum exact
        part = (weight >> low) & ((1 << 31) - 1)
        out[: CELLS - MASKS] += np.bincount(cell.ravel(), np.repeat(part, len(ORDERS)), CELLS - MASKS).astype(np.int64) << low
    out[CELLS - MASKS :] = classes.reshape(MASKS, LABELS).sum(axis=1)
    return out


def report(cells: np.ndarray) -> dict[str, list]:
    """The 600 rows of a part from the sum of its partial arrays."""
    steps, masks = cells[: CELLS - MASKS].reshape(len(ORDERS), STEPS, LABELS), cells[CELLS - MASKS :]
    fails = [int(masks[[m for m in range(MASKS) if m >> k & 1]].sum()) for k in range(len(FILTERS))]
    taken = steps.sum(axis=2)
    shapley = [int(taken[np.arange(len(ORDERS)), PLACE[k]].sum()) for k in range(len(FILTERS))]
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", *COUNTS)}
    for o, order in enumerate(ORDERS):
        left = int(masks.sum())
        for step in range(1, STEPS):
            k, gone = FILTERS.index(order[step - 1]), int(taken[o, step])
            left -= gone
            good, toxic = int(steps[o, step, [1, 3]].sum()), int(steps[o, step, [2, 3]].sum())
            for c, v in zip(out, (order, step, left, gone, fails[k] - gone, int(masks[1 << k]), good, toxic, shapley[k]), strict=True):
                out[c].append(v)
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _masks(batches):
    for batch in batches:
        for a, b in textops.groups(batch.column(3)):
            rows = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(failures(rows.column(3)), pa.int64())], ["doc_id", "part", "digest", "mask"])


def _partial(batches):
    """Rows (part, cell, n) of a task's partial arrays, without zeros."""
    held: dict[str, np.ndarray] = {}

    def flush():
        for part, cells in held.items():
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(cells[some], pa.int64())], ["part", "cell", "n"])
        held.clear()

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        code, masks, labels, times = parts.indices.to_numpy(), *(batch.column(k).to_numpy() for k in (1, 2, 3))
        for k, part in enumerate(parts.dictionary.to_pylist()):
            mine = code == k
            found = removals(masks[mine], labels[mine], times[mine])
            held[part] = held[part] + found if part in held else found
            if len(held) >= PARTS:
                yield from flush()
    yield from flush()


def _reports(batches):
    for batch in batches:
        for part, cells, n in zip(*(batch.column(k) for k in range(3)), strict=True):
            whole = np.zeros(CELLS, dtype=np.int64)
            whole[cells.values.to_numpy()] = n.values.to_numpy()
            rows = report(whole)
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(rows["step"]), pa.string()), *(pa.array(v, {"filter_order": pa.string(), "step": pa.int32()}.get(c, pa.int64())) for c, v in rows.items())], ["part", *rows])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts): 600 rows for each language of docs, one for each step of each order of five filters.

    A text fails A with fewer than 200 words, B if fewer than half of its words are distinct, C if more than 3 % of its
    characters are A-Z, D if it holds one of ``#$%&*|``, E if a row with a smaller doc_id has the same text (by SHA-256).
    Tasks look up the step at which each combination of failures goes in each order, and add up arrays of removals by label;
    the arrays are summed by part. Equal rows are folded before any shuffle, so a text of many copies is few rows.

    A null or empty text has no words: it fails A alone, and E as a copy of other such texts. A null lang is the part ''.
    Rows with the same doc_id don't make each other fail E; a row without doc_id neither fails E, nor makes others fail, and
    has no label. Several labels of a doc_id count as 1 if one of them is 1; a label of another document counts for nothing.
    Texts of any length are measured whole; an empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    given, marks = Given(docs), Given(labels)
    text = F.coalesce(given["text"].cast("string"), F.lit(""))
    rows = given.table.select(given["doc_id"].cast("long").alias("doc_id"), F.coalesce(given["lang"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    rows = rows.mapInArrow(_masks, "doc_id long, part string, digest binary, mask long").groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.when(marks[c] == 1, 1).otherwise(0))
    known = marks.table.where(marks["doc_id"].isNotNull()).groupBy(marks["doc_id"].cast("long").alias("id")).agg((flag("quality") + 2 * flag("toxic")).cast("long").alias("label"))
    # rows without doc_id meet no label, and are spread over many keys
    keys = rows.withColumn("key", F.coalesce("doc_id", F.lit(0))).withColumn("spread", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(F.lit(0)))
    both = keys.join(known.where("label > 0").withColumn("none", F.lit(0).cast("long")), (F.col("key") == F.col("id")) & (F.col("spread") == F.col("none")), "left")
    both = both.select("digest", "doc_id", "part", "mask", "n", F.coalesce("label", F.lit(0)).alias("label"))
    # of each class of a text the rows with its least doc_id, and all others
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = both.groupBy("digest", "part", "mask", "label").agg(least.alias("least"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("free"))
    own = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("fine", F.col("free") + F.when(own, F.col("least.n")).otherwise(F.lit(0)))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("fine").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fine")).alias("n")))
    masks = kinds.select("part", "label", F.explode(split).alias("s")).select("part", "s.mask", "label", "s.n").where("n > 0")
    cells = masks.mapInArrow(_partial, "part string, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("all")).select("part", F.col("all.cell").alias("cell"), F.col("all.n").alias("n"))
    return scratch.keep(whole.mapInArrow(_reports, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}"))
