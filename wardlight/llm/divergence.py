"""How far the sources of a language differ in their use of words: all pairs of sources, and each source's most particular terms."""

from __future__ import annotations

from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .columns import Given
from .store import Scratch

#: Documents of a language that have a kept term at least, ranks of terms that are reported, and the scale of shares.
LEAST_DOCS, RANKS, SCALE = 10, 10, 1_000_000_000
#: Terms of a tile, and groups on each side of it; int64 cells that are computed at once.
TERMS, GROUPS, AT_ONCE = 512, 256, 1 << 19

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact for totals up to 9 * 10**15: long division, three digits at a time."""
    rest, out = np.broadcast_to(count + 2, np.broadcast_shapes(count.shape, total.shape)).astype(np.int64), 0
    whole, rest = rest // total, rest % total
    out = whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of shares, which fits in int64."""
    gap = p - q
    return gap * gap // (p + q)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """These byte ranges as strings."""
    size = end - start
    ends = np.cumsum(size)
    places = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[places])).cast(pa.string())


def _counts(batches):
    """Rows (lang, source, term, n, docs): occurrences of each term in a batch, and the texts that have it. A null term stands for the group itself."""
    for batch in batches:
        for a, b in textops.groups(batch.column(2)):
            rows = batch.slice(a, b - a)
            data, offsets = textops.buffers(rows.column(2))
            data = textops.LOWER[data]
            w = textops.words(data, offsets, _LETTERS, False)
            owner = np.repeat(np.arange(len(rows)), np.diff(w.first))
            both = pa.StructArray.from_arrays(rows.columns[:2], ["lang", "source"])
            names = pc.rank(pa.array([f"{len(x)}:{x}{y}" for x, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)], pa.string()), tiebreaker="dense").to_numpy().astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            order = np.lexsort((owner, w.hash, names[owner]))
            g, h, d = names[owner][order], w.hash[order], owner[order]
            fresh, doc = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
            fresh[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            doc[1:] = fresh[1:] | (d[1:] != d[:-1])
            at = np.flatnonzero(fresh)
            of = order[at]
            n = np.diff(np.append(at, len(h)))
            docs = np.add.reduceat(doc, at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)
            held = np.unique(names, return_index=True)[1]
            groups = both.take(pa.array(np.concatenate([owner[of], held])))
            terms = pa.concat_arrays([_slices(data, w.start[of], w.end[of]), pa.nulls(len(held), pa.string())])
            zeros = np.zeros(len(held), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*groups.flatten(), terms, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([docs, zeros]))], ["lang", "source", "term", "n", "docs"])


class _Tile:
    """Sums of a run of tiles of the same language and sides: distances of pairs of groups, and the best terms of each group."""

    def __init__(self, lang: str, sides: tuple[int, int], sources: list[str], side: np.ndarray, totals: np.ndarray, of_lang: tuple[int, int]):
        self.lang, self.sources, self.totals = lang, sources, totals
        self.rows, self.cols = np.flatnonzero(side == sides[0]), np.flatnonzero(side == sides[1])
        self.same = sides[0] == sides[1]
        self.n, self.v = of_lang
        self.set = pa.array(sources, pa.string())
        self.sums = np.zeros((len(self.rows), len(self.cols)), dtype=np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in sources]

    def add(self, terms: pa.Array, of_lang: np.ndarray, entries: pa.Array) -> None:
        """Some terms: their counts in the language, and (source, count) of the groups that have them."""
        flat = entries.flatten()
        where = pc.index_in(flat.field("source"), self.set)
        mine = where.is_valid().to_numpy(zero_copy_only=False)
        term = np.repeat(np.arange(len(terms)), pc.list_value_length(entries).to_numpy(zero_copy_only=False))[mine]
        count = np.zeros((len(self.sources), len(terms)), dtype=np.int64)
        count[where.filter(where.is_valid()).to_numpy(), term] = flat.field("n").to_numpy()[mine]
        p = share(count, (self.totals + 2 * self.v)[:, None])
        left, right = p[self.rows], p[self.cols]
        step = max(1, AT_ONCE // max(1, right.size))
        for low in range(0, len(left), step):
            self.sums[low : low + step] += distance(left[low : low + step, None, :], right[None]).sum(axis=2)
        if not self.same:
            return
        q = share(of_lang, np.array([self.n + 2 * self.v]))
        value = np.where((count > 0) & (p > q), distance(p, q), -1)
        for i in np.flatnonzero((value >= 0).any(axis=1)).tolist():
            heap = self.best[i]
            own = value[i]
            some = np.flatnonzero(own >= 0)
            if len(some) > RANKS:  # ties at the last place stay
                some = some[own[some] >= np.partition(own[some], -RANKS)[-RANKS]]
            heap += [(-int(own[t]), terms[t].as_py().encode()) for t in some.tolist()]
            self.best[i] = nsmallest(RANKS, heap)

    def result(self) -> pa.RecordBatch:
        rows = []
        for i, row in enumerate(self.sums.tolist()):
            for j, value in enumerate(row):
                a, b = self.rows[i], self.cols[j]
                if a != b:
                    rows.append((self.lang, self.sources[a], "pair", self.sources[b], value))
                    if not self.same:
                        rows.append((self.lang, self.sources[b], "pair", self.sources[a], value))
        rows += [(self.lang, self.sources[i], "term", t.decode(), -v) for i, heap in enumerate(self.best) for v, t in heap]
        return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, [pa.string()] * 4 + [pa.int64()], strict=True)], ["lang", "source", "part", "item", "value"])


def _tiles(batches):
    """Tiles come in turn: the groups of a tile first (null term; the language itself has a null source), then its terms."""
    name = now = block = None
    head: list[tuple] = []

    def begun():
        whole = next((n, v) for s, _, n, v in head if s is None)
        groups = sorted((s, side, n) for s, side, n, _ in head if s is not None)
        return _Tile(name[0], name[1:], [s for s, _, _ in groups], np.array([x for _, x, _ in groups], dtype=np.int64), np.array([n for _, _, n in groups], dtype=np.int64), whole)

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
        header = batch.column(4).is_null().to_pylist()
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at] and header[stop] == header[at]:
                stop += 1
            rows = batch.slice(at, stop - at)
            if keys[at][:3] != name:
                if name is not None:
                    yield (now or begun()).result()
                name, now, block, head = keys[at][:3], None, keys[at][3], []
            if header[at]:
                if now is None and keys[at][3] == block:  # the same groups stand before each further block
                    head += zip(*(rows.column(k).to_pylist() for k in (5, 6, 7, 8)), strict=True)
            else:
                now = now or begun()
                for low in range(0, len(rows), TERMS):
                    part = rows.slice(low, TERMS)
                    now.add(part.column(4), part.column(7).to_numpy(), part.column(9))
            at = stop
    if name is not None:
        yield (now or begun()).result()


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups, a group being the documents of a language and source.

    Terms are runs of letters (bytes outside ASCII count as such) with A-Z lower-cased; those in LEAST_DOCS documents of
    a language or more are kept there. Part ``pair`` has a row for each other source of the language, part ``term`` the
    group's best ten terms against the language. All numbers are integers and exact. The terms of a language are dealt
    into blocks by hash and its groups into sides; a task holds the int64 counts of a block for the groups of two sides,
    compares all their pairs by broadcasting, and adds the pair matrices and the groups' heaps of its blocks up before
    they are merged by group. Memory: GROUPS by TERMS counts, whatever the number of sources or terms.

    A null lang, source or text is ''. A group without terms, or of a language without kept terms, has pairs (of value 0
    if nothing is kept) and no terms; a source that is alone in its language has no pairs. Equal values rank by the
    item's bytes. Repeated rows count again; texts and terms of any length are read whole; an empty table gives an empty
    result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    given = Given(docs)
    rows = given.table.select(*(F.coalesce(given[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = scratch.keep(counted)
    terms = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
    terms = scratch.keep(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    held = counted.where("term is null").select("lang", "source")
    of_term = terms.select("lang", F.explode("entries").alias("e")).select("lang", "e.source", "e.n", F.lit(0).alias("v"))
    of_lang = terms.select("lang", F.lit(None).cast("string").alias("source"), "n", F.lit(1).alias("v"))
    none = [held.select("lang", "source", F.lit(0).alias("n"), F.lit(0).alias("v")), held.select("lang", F.lit(None).cast("string").alias("source"), F.lit(0).alias("n"), F.lit(0).alias("v"))]
    groups = of_term.unionByName(of_lang).unionByName(none[0]).unionByName(none[1]).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("v").cast("long").alias("v"))
    groups = scratch.keep(groups)
    most = groups.groupBy("lang").agg(F.sum("v").alias("v"), F.count("source").alias("s")).agg(F.max("v").alias("v"), F.max("s").alias("s")).first()
    blocks, sides = max(1, -(-(most["v"] or 0) // TERMS)), max(1, -(-(most["s"] or 0) // (GROUPS // 2)))
    side = lambda source: F.pmod(F.xxhash64(source), F.lit(sides)).cast("int")
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(sides) for b in range(a, sides)))) if sides <= 32 else None
    if pairs is None:  # too many for one expression
        grid = F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda a: F.transform(F.sequence(a, F.lit(sides - 1)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
        pairs = F.explode(F.flatten(grid))
    head = groups.withColumn("side", F.when(F.col("source").isNotNull(), side("source"))).select("lang", "source", "side", "n", "v", pairs.alias("t")).where("side is null or side = t.a or side = t.b")
    head = head.select("lang", "t.a", "t.b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("string").alias("term"), "source", "side", "n", "v", F.lit(None).cast(terms.schema["entries"].dataType).alias("entries"))
    body = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).select("lang", pairs.alias("t"), "block", "term", "n", "entries")
    mine = F.filter("entries", lambda e: (side(e["source"]) == F.col("t.a")) | (side(e["source"]) == F.col("t.b"))) if sides > 1 else F.col("entries")
    body = body.select("lang", "t.a", "t.b", "block", "term", F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("side"), "n", F.lit(None).cast("long").alias("v"), mine.alias("entries"))
    tiles = head.unionByName(body).repartition("lang", "a", "b", "block").sortWithinPartitions("lang", "a", "b", "block", F.col("term").asc_nulls_first())
    found = tiles.mapInArrow(_tiles, "lang string, source string, part string, item string, value long")
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    out = scratch.keep(ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS)))
    scratch.drop(counted, terms, groups)
    return out
