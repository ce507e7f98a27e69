"""Exact Jaccard join of shingle sets as a join in a metric space: pivots, Voronoi regions, windows at their borders."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .cells import excess, join_cells
from .components import connected_components
from .store import Scratch, filtered_scans

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Orders of the tokens in which regions are sought.
ROUNDS = 3
#: Tokens in MANY documents or more of a sample (one in SAMPLE) go to the end of the order of tokens, the MOST_COMMON most frequent at most.
SAMPLE, MANY, MOST_COMMON = 16, 3, 100_000
#: Documents whose differences to one pivot are measured in one task's share.
A_SHARE = 1024
CELLS = 256
#: Holds for every row; the optimizer builds a Bloom filter only from a side that has some condition.
_SOME = "{0} >= -9223372036854775807 or {0} <= 0"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one; empty without words."""
    data, offsets = textops.buffers(texts)
    w = textops.words(data, offsets, textops.VISIBLE, True)
    runs = textops.shingles(w.hash, size).view(np.int64)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(textops.shingles(w.hash[a:b], b - a).view(np.int64) ^ np.int64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def window(n, percent: int = PERCENT):
    """How many of n tokens in order must be looked at, so that no partner shares none of them: n minus the least overlap, plus one."""
    return n - (percent * n + 99) // 100 + 1


def _each_text(batches, size: int, body):
    """Calls body(batch of rows, their sets) for groups of rows of bounded text size. Text is the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for a, b in textops.groups(texts):
            yield body(batch.slice(a, b - a), shingle_sets(texts.slice(a, b - a), size))


def _name(s: np.ndarray) -> int:
    """64 bits that name a set of tokens."""
    return int(textops.mix(s.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _least_shared(n: int, percent: int) -> int:
    """How many of the first tokens of a set of n must be among the first of others, if it has a partner.

    A partner of m tokens has all but ``window(m) - 1`` of them in common with the set, so each of the two has as many common
    tokens in its head as the head is longer than that, and those that come first are in both. The smallest partner counts.
    """
    m = -(-percent * n // 100)
    return min(-(-percent * m // 100), _head(m, percent) - window(m, percent) + 1)


def _head(n: int, percent: int) -> int:
    """How many first tokens are looked at: the window, and a twentieth of the set more, as single tokens meet by chance in a large corpus."""
    return min(n, window(n, percent) + n // 20 + 4)


def _ordered(sets: list[np.ndarray], common: np.ndarray) -> list[np.ndarray]:
    """Each set in the order of its tokens' numbers, but with common ones (sorted) last."""
    if not len(common) or not sets:
        return sets
    tokens = np.concatenate(sets)
    late = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = tokens[np.argsort(2 * owner + late, kind="stable")]
    return np.split(tokens, np.cumsum([len(s) for s in sets])[:-1])


def signatures(docs: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, n, id, head, need): set size, 64 bits that name the set, its first tokens, and how many of these others must share.

    The order of tokens has common ones last, so a shared boilerplate makes no document a candidate. Of equal sets that
    come together one has a head.
    """

    def body(rows, sets):
        names, first = [_name(s) for s in sets], {}
        for i, x in enumerate(names):
            first.setdefault(x, i)
        heads = [s[: _head(len(s), percent)] if first[x] == i else s[:0] for i, (s, x) in enumerate(zip(_ordered(sets, common), names, strict=True))]
        need = [_least_shared(len(s), percent) if len(s) else 0 for s in sets]
        columns = [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), _lists(heads), pa.array(need, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "id", "head", "need"])

    return docs.select("doc_id", "text").mapInArrow(lambda x: _each_text(x, size, body), "doc_id long, n long, id long, head array<long>, need long")


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Tokens that many documents of a sample have. They only change the order in which tokens are looked at, no result."""

    def body(rows, sets):
        token, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    some = docs.where("doc_id is not null and text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = some.select("doc_id", "text").mapInArrow(lambda x: _each_text(x, size, body), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= MANY)
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()["token"].to_numpy())


def _points(rows: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(id, text, n, keys, cells, tokens) of the rows (id, text) whose text has the set that id names.

    keys: for each of ROUNDS orders of the tokens, the first of the set. tokens: the first ``window(n)`` in an order with
    common ones last; a partner shares one of them. cells counts all tokens by hash, at most 255 each.
    """

    def body(rows, sets):
        names = [_name(s) for s in sets]
        good = [i for i, (x, y) in enumerate(zip(names, rows.column(0).to_pylist(), strict=True)) if x == y]
        sets, rows = [sets[i] for i in good], rows.take(pa.array(good, pa.int64()))
        first = [s[: window(len(s), percent)] for s in _ordered(sets, common)]
        keys = [np.array([textops.mix(s.view(np.uint64) + np.uint64(r)).min() for r in range(ROUNDS)], dtype=np.uint64).view(np.int64) for s in sets]
        counts = [np.minimum(np.bincount((s.view(np.uint64) >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes() for s in sets]
        columns = [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), _lists(keys), pa.array(counts, pa.binary()), _lists(first)]
        return pa.RecordBatch.from_arrays(columns, ["id", "text", "n", "keys", "cells", "tokens"])

    return rows.select("id", "text").mapInArrow(lambda x: _each_text(x, size, body), "id long, text string, n long, keys array<long>, cells binary, tokens array<long>")


def _differences(tasks: DataFrame, core: DataFrame, size: int) -> DataFrame:
    """(id, pivot, n, np, diff) for tasks (id, pivot): set sizes, and the tokens that only one of the two has.

    A pivot of many tasks is dealt in shares, so no task holds all of a hot one.
    """

    def run(batches):
        for batch in batches:
            for a, b in textops.groups(batch.column(2)):
                part = batch.slice(a, b - a)
                xs, ps = shingle_sets(part.column(2), size), shingle_sets(part.column(3), size)
                diffs = [np.setxor1d(x, p, assume_unique=True) for x, p in zip(xs, ps, strict=True)]
                columns = [part.column(0), part.column(1), pa.array([len(x) for x in xs], pa.int64()), pa.array([len(p) for p in ps], pa.int64()), _lists(diffs)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "pivot", "n", "np", "diff"])

    shares = tasks.groupBy("pivot").agg(F.ceil(F.count("*") / A_SHARE).cast("int").alias("shares"))
    pivots = core.join(shares.where(_SOME.format("pivot")).withColumnRenamed("pivot", "id"), "id").select(F.col("id").alias("pivot"), F.explode(F.sequence(F.lit(1), "shares")).alias("share"), F.col("text").alias("p"))
    dealt = tasks.join(shares, "pivot").select("id", "pivot", (F.pmod(F.xxhash64("id"), F.col("shares")) + 1).cast("int").alias("share"))
    rows = core.select("id", "text").join(dealt.where(_SOME.format("id")), "id").join(pivots, ["pivot", "share"]).select("id", "pivot", "text", "p")
    return rows.mapInArrow(run, "id long, pivot long, n long, np long, diff array<long>")


def _regions(core: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(id, n, region): the Voronoi region of each point, named by the point that is its pivot; and the differences measured on the way.

    In each round points with the same first token meet. The largest region among them gives the pivot; who stands
    nearer to it than half of its own set enters that region. A family of copies that an edit has split in one
    order of the tokens meets in the next.
    """
    keys = core.select("id", "n", "keys")
    now, measured = keys.select("id", "n", F.col("id").alias("region")), []
    for r in range(ROUNDS):
        placed = now.join(keys.select("id", F.element_at("keys", r + 1).alias("key")), "id")
        votes = placed.groupBy("key", "region").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "region")).alias("best"), F.sum("m").alias("all")).where(F.col("all") > 1)
        tasks = placed.join(votes.select("key", F.col("best.region").alias("pivot")), "key").where("pivot <> region and pivot <> id").select("id", "pivot")
        measured.append(scratch.keep(_differences(scratch.keep(tasks), core, size).where(2 * F.size("diff") <= F.col("n"))))
        later = now.join(measured[-1].select("id", "pivot"), "id", "left").select("id", "n", F.coalesce("pivot", "region").alias("region"))
        # a pivot that has itself moved on leads to where it went
        moved = later.where("id <> region").select(F.col("id").alias("region"), F.col("region").alias("to"))
        now = scratch.keep(later.join(moved, "region", "left").select("id", "n", F.when(F.col("to") == F.col("id"), F.col("id")).otherwise(F.coalesce("to", "region")).alias("region")))
    return now, measured


def _members(regions: DataFrame, measured: list[DataFrame], core: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(id, pivot, n, np, diff) of each point in a region that isn't its pivot."""
    wanted = regions.where("region <> id").select("id", F.col("region").alias("pivot"))
    known = reduce(DataFrame.unionByName, measured).dropDuplicates(["id", "pivot"])
    known = scratch.keep(known.join(wanted, ["id", "pivot"], "left_semi"))
    rest = scratch.keep(wanted.join(known.select("id", "pivot"), ["id", "pivot"], "left_anti"))
    return scratch.keep(known.unionByName(_differences(rest, core, size)))


def _visitors(core: DataFrame, regions: DataFrame, members: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, pivot, n, np, diff) of each point of a smaller region that may be linked with one of a larger: it is replicated there.

    Linked points share a token of their windows, so each such token that stands in several regions makes a point a
    candidate for the larger ones. By the triangle inequality a point can only be linked with a member of a region if it is no
    farther from the pivot than the farthest member and the threshold together: the region's ``reach``. Distances are
    first bounded by counts of tokens: summed over disjoint parts of the universe, they obey the same inequality.
    """
    far = members.groupBy(F.col("pivot").alias("region")).agg(F.count("*").alias("others"), F.max(F.lit(100 + percent) * F.size("diff") + F.lit(100 - percent) * F.col("n")).alias("far"))
    about = regions.where("id = region").join(far, "region", "left").select("region", F.coalesce("others", F.lit(0)).alias("others"), F.greatest(F.coalesce("far", F.lit(0)), F.lit(100 - percent) * F.col("n")).alias("reach"))
    about = scratch.keep(about)
    where = regions.select("id", "region").join(about.select("region", "others"), "region")
    rows = scratch.keep(core.select("id", "n", "tokens").join(where, "id").select("id", "n", "region", "others", F.posexplode("tokens").alias("place", "token")))
    met = rows.groupBy("token", "region").agg(F.first("others").alias("_others"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("place")).alias("rest")).withColumnRenamed("region", "pivot")
    met = scratch.keep(met)
    mixed = met.groupBy("token").agg(F.min("pivot").alias("r1"), F.max("pivot").alias("r2")).where("r1 < r2").select("token")
    x = rows.join(mixed.hint("shuffle_hash"), "token")
    larger = (F.col("_others") > F.col("others")) | (F.col("_others") == F.col("others")) & (F.col("pivot") > F.col("region"))
    least = F.greatest(F.col("lo"), F.ceil(F.lit(percent) * F.col("n") / 100 - 1e-9))  # the smallest set of the region that can be a partner
    fits = larger & (100 * F.col("n") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("n"))
    fits = fits & ((100 + percent) * F.least(F.col("n") - F.col("place"), F.col("rest")) >= percent * (F.col("n") + least))
    pairs = x.join(met, "token").where(fits).select("id", "pivot").distinct()
    cells = core.select("id", "n", "cells")
    pairs = pairs.join(cells.withColumnRenamed("cells", "x"), "id").join(cells.select(F.col("id").alias("pivot"), F.col("cells").alias("y")), "pivot").join(about.select(F.col("region").alias("pivot"), "reach"), "pivot")

    def near(batches):
        for batch in batches:
            n, reach = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16) for k in (4, 5))
            good = (100 + percent) * np.abs(x - y).sum(axis=1, dtype=np.int64) - (100 - percent) * n <= reach
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], ["id", "pivot"])

    tasks = scratch.keep(pairs.select("id", "pivot", "n", "reach", "x", "y").mapInArrow(near, "id long, pivot long"))
    found = _differences(tasks, core, size).join(about.select(F.col("region").alias("pivot"), "reach"), "pivot")
    return scratch.keep(found.where(excess(F.size("diff").cast("long"), F.col("n"), percent) <= F.col("reach")).select("id", "pivot", "n", "np", "diff"))


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: the smallest doc_id that links lead to.

    Equal sets are one point. A point can only have a partner if enough of its first tokens occur in others; only such
    points go on, with their texts. They fall into Voronoi regions around pivots; points that may be linked with a
    member of a larger region are replicated there; and each region with its visitors is joined by the tokens of the differences
    to its pivot, in one task or, if it is large, recursively in parts with new pivots. So no link between different
    components is lost, and no group of copies is spelled out in pairs.

    Tokens are 64-bit hashes of shingles. A null or empty text has an empty set, links with nothing, and is its own
    component; a row without doc_id has a null component and links nothing; rows that repeat a doc_id with other texts are
    linked by that; texts of any length are taken whole; an empty table gives an empty result; further columns are ignored.
    """
    with filtered_scans(docs.sparkSession):
        return _components(docs, size, percent)


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = _common(docs, size)
    signed = scratch.keep(signatures(docs, common, size, percent))
    sets = signed.where("n > 0 and doc_id is not null")
    points = scratch.keep(sets.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.max("need").alias("need"), F.count_if(F.size("head") > 0).alias("heads")))

    tokens = sets.select("id", F.explode("head").alias("token"))
    shared = scratch.keep(tokens.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("token"))
    scratch.sweep()
    seen = tokens.join(shared.hint("shuffle_hash"), "token").groupBy("id").agg(F.count("*").alias("seen"))
    chosen = scratch.keep(points.join(seen, "id").where("seen >= need * heads").select("id", "doc_id"))
    scratch.sweep()
    core = scratch.keep(_points(docs.join(chosen.where(_SOME.format("doc_id")), "doc_id"), common, size, percent))
    again = core.groupBy("id").count().where("count > 1").select("id")
    if not again.isEmpty():  # rows with equal doc_id and equal sets
        core = scratch.keep(core.join(again, "id", "left_anti").unionByName(core.join(again, "id", "left_semi").dropDuplicates(["id"])))
    scratch.sweep()

    regions, measured = _regions(core, size, scratch)
    members = _members(regions, measured, core, size, scratch)
    visitors = _visitors(core, regions, members, size, percent, scratch)
    scratch.sweep()

    placed_here = members.unionByName(visitors)
    linked = (100 + percent) * F.size("diff") <= F.lit(100 - percent) * (F.col("n") + F.col("np"))
    at_pivot = placed_here.where(linked).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    own = placed_here.select("pivot", F.col("np").alias("n")).distinct().select(F.col("pivot").alias("id"), F.col("pivot"), "n", F.col("pivot").alias("label"), F.array().cast("array<long>").alias("tokens"))
    cells = placed_here.select("id", "pivot", "n", F.when(linked, F.col("pivot")).otherwise(F.col("id")).alias("label"), F.col("diff").alias("tokens")).unionByName(own)
    cells = scratch.keep(cells.select(F.hex("pivot").alias("cell"), "id", "n", "label", "tokens"))
    links = at_pivot.unionByName(join_cells(cells, percent, scratch))
    twice = sets.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    links = links.unionByName(sets.join(twice, "doc_id").select(F.col("lo").alias("a"), F.col("id").alias("b")))
    whole = scratch.keep(connected_components(scratch.keep(links), scratch))

    grouped = points.join(whole.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("c"))
    least = grouped.groupBy("c").agg(F.min("doc_id").alias("least"))
    names = grouped.join(least, "c").select(F.col("id").alias("_id"), "least")
    out = signed.select("doc_id", "n", "id").join(names, (F.col("id") == F.col("_id")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    result = scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")))
    scratch.drop(*[t for t in scratch.held if t is not result])
    scratch.sweep()
    return result
