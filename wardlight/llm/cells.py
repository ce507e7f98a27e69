"""Exact similarity join inside cells: groups of token sets that are to be compared with each other.

A set stands for its symmetric difference to a common point of the cell (a pivot, or the empty set): what only one of
two sets has is the same as what only one of their differences has. With k tokens in the difference of a set of n, let
``excess`` = (100 + p) k - (100 - p) n. Two sets have a Jaccard similarity of p percent or more exactly if
their differences share (excess + excess') / (2 (100 + p)) tokens or more.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Members of a cell, and tokens of all their differences, that one task joins; a larger cell is split. FEW members are joined whatever their size.
MEMBERS, TOKENS, FEW = 2048, 1 << 22, 16


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... (count[i] of them) for each i in turn."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def local_links(n: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between members of one cell, as many as connect all that are linked; equal labels are connected already."""
    many = len(n)
    group = np.unique(labels, return_inverse=True)[1]
    owner = np.repeat(np.arange(many), [len(s) for s in sets])
    tokens, token = np.unique(np.concatenate(sets) if many else np.zeros(0, np.int64), return_inverse=True)
    df = np.bincount(token, minlength=len(tokens))
    size = np.bincount(owner, minlength=many).astype(np.int64)
    usual = np.flatnonzero(2 * df > many)
    if len(usual):  # measured from the point that has what most members have
        has = np.zeros((len(usual), many), dtype=bool)
        column = np.full(len(tokens), -1, dtype=np.int64)
        column[usual] = np.arange(len(usual))
        mine = column[token] >= 0
        has[column[token[mine]], owner[mine]] = True
        lacking, who = np.nonzero(~has)
        token, owner = np.concatenate([token[~mine], usual[lacking]]), np.concatenate([owner[~mine], who])
        size = np.bincount(owner, minlength=many).astype(np.int64)
        df = np.bincount(token, minlength=len(tokens))
    excess = (100 + percent) * size - (100 - percent) * n.astype(np.int64)
    found = []

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if group[i] != group[j]:
                found.append((i, j))
                group[group == group[j]] = group[i]

    least = int(excess.argmin())
    join(least, np.flatnonzero(excess <= -excess[least]))
    shared = df[token] > 1
    token, owner = token[shared], owner[shared]
    by_token, by_owner = np.argsort(token, kind="stable"), np.argsort(owner, kind="stable")
    posting = owner[by_token]
    begin = np.cumsum(df * (df > 1)) - df * (df > 1)
    first = np.searchsorted(owner[by_owner], np.arange(many + 1))
    mine = token[by_owner]
    for i in range(1, many):
        if (group == group[i]).all():
            break
        own = mine[first[i] : first[i + 1]]
        if not len(own):
            continue
        met = np.bincount(posting[_ragged(begin[own], df[own])], minlength=many)[:i]
        join(i, np.flatnonzero((met > 0) & (2 * (100 + percent) * met >= excess[i] + excess[:i]) & (group[:i] != group[i])))
    return found


def _local(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside cells that are small enough for one task. Cells come one after the other, and one at a time is held."""

    def flush(rows):
        whole = pa.Table.from_batches(rows)
        ids = whole["id"].to_numpy()
        lists = whole["tokens"].combine_chunks()
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        sets = [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        links = local_links(whole["n"].to_numpy(), whole["label"].to_numpy(), sets, percent)
        return [(int(ids[i]), int(ids[j])) for i, j in links]

    def run(batches):
        held, name, out = [], None, []
        for batch in batches:
            names = batch.column(0).to_pylist()
            at = 0
            while at < len(names):
                stop = at + 1
                while stop < len(names) and names[stop] == names[at]:
                    stop += 1
                if held and names[at] != name:
                    out += flush(held)
                    held = []
                name = names[at]
                held.append(batch.slice(at, stop - at))
                at = stop
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if held:
            out += flush(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    rows = cells.select("cell", "id", "n", "label", "tokens").repartition("cell").sortWithinPartitions("cell", "id")
    return rows.mapInArrow(run, "a long, b long")


def excess(k: Column, n: Column, percent: int) -> Column:
    return F.lit(100 + percent) * k - F.lit(100 - percent) * n


def _split(cells: DataFrame, large: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links that need no comparison, and smaller cells that hold all other pairs, of cells too large for a task.

    The new pivot of a cell is the point that has each token that most members have. Members near enough to it are
    linked with the nearest one. Any other linked pair shares one of its rarest tokens, as many as its window has;
    so each member goes into the cells of these. As no token is in more than half of the differences to such a
    pivot, cells at least halve.
    """
    rows = scratch.keep(cells.join(large.select("cell", "m"), "cell"))
    df = rows.select("cell", "m", F.explode("tokens").alias("token")).groupBy("cell", "token").agg(F.count("*").alias("df"), F.first("m").alias("m"))
    df = scratch.keep(df.where("df > 1"))
    usual = df.where("2 * df > m").groupBy("cell").agg(F.collect_list("token").alias("usual"))  # at most twice the mean size of a difference
    empty = F.array().cast("array<long>")
    rows = rows.join(usual, "cell", "left").withColumn("usual", F.coalesce("usual", empty))
    flipped = F.concat(F.array_except("tokens", "usual"), F.array_except("usual", "tokens"))
    rows = scratch.keep(rows.select("cell", "id", "n", "label", "m", flipped.alias("tokens")).withColumn("e", excess(F.size("tokens").cast("long"), F.col("n"), percent)))
    nearest = rows.groupBy("cell").agg(F.min(F.struct("e", "id", "label")).alias("head"))
    rows = rows.join(nearest, "cell")
    at_once = F.col("e") <= -F.col("head.e")
    links = scratch.keep(rows.where(at_once & (F.col("label") != F.col("head.label"))).select(F.col("head.id").alias("a"), F.col("id").alias("b")))
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("head.e")) / (2 * (100 + percent)) - 1e-9))
    rows = rows.select("cell", "id", "n", F.when(at_once, F.col("head.label")).otherwise(F.col("label")).alias("label"), "tokens", (F.size("tokens") - need + 1).alias("room"))
    rows = scratch.keep(rows)
    spread = rows.where("room > 0").select("cell", "id", "label", "room", F.size("tokens").alias("k"), F.explode("tokens").alias("token"))
    counted = df.select("cell", "token", F.when(F.col("df") * 2 > F.col("m"), F.col("m") - F.col("df")).otherwise(F.col("df")).alias("df")).where("df > 1")
    spread = scratch.keep(spread.join(counted, ["cell", "token"]))
    shared = F.count("*").over(Window.partitionBy("cell", "id"))
    # tokens that no other member has come first and fill the front of the window
    place = F.row_number().over(Window.partitionBy("cell", "id").orderBy("df", "token")) + F.col("k") - shared
    spread = scratch.keep(spread.withColumn("place", place).where("place <= room").select("cell", "id", "label", "token"))
    wanted = spread.groupBy("cell", "token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cell", "token")
    child = F.concat("cell", F.lit("/"), F.hex("token"))
    spread = spread.join(wanted, ["cell", "token"]).select("cell", "id", child.alias("child"))
    return links, scratch.keep(spread.join(rows, ["cell", "id"]).select(F.col("child").alias("cell"), "id", "n", "label", "tokens"))


def join_cells(cells: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between members of one cell, as many as connect all linked members with different labels.

    cells: (cell string, id, n, label, tokens): set size, and the distinct tokens of the difference to the cell's point.
    Members with equal labels count as connected. Cells that fit a task are joined there, larger ones are split until
    they do. An empty table gives an empty result.
    """
    links = []
    while True:
        stats = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum(F.size("tokens")).alias("w"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        stats = scratch.keep(stats)
        fits = (F.col("m") <= FEW) | (F.col("m") <= MEMBERS) & (F.col("w") <= TOKENS)
        links.append(scratch.keep(_local(cells.join(stats.where(fits).select("cell"), "cell"), percent)))
        large = stats.where(~fits)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, links)
        more, cells = _split(cells, large, percent, scratch)
        links.append(more)
