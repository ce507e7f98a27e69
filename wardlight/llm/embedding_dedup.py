"""Near-duplicate embeddings: vectors that collide in enough windows of one-dimensional projections are compared by cosine."""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import Given
from .components import connected_components
from .store import Scratch

#: Projections whose windows are counted, and half a window's width in distances of a pair at the threshold.
PROJECTIONS, WIDTH = 16, 1.5
#: Part of the pairs at the threshold that the count lets pass, and part of them that the tables bring together at least.
COUNT_RECALL, TABLE_RECALL = 0.9995, 0.99
#: Vectors in a bucket that are aimed at, in a tile at most, and the most tables. Lengths of vectors that are centred (the most frequent ones).
AIM, TILE, TABLES, LENGTHS = 1024, 4096, 64, 64
#: Tables that are dealt out at a time; large buckets that are broadcast at most, and shares of each beyond that; queries that a task counts at once.
TURN, LARGE, SHARES, QUERIES = 4, 1 << 16, 64, 128


class Plan(NamedTuple):
    """What decides which pairs meet: bits of a bucket, number of tables, half width of a window, and collisions that a pair needs."""

    bits: int
    tables: int
    half: float
    least: int


def least_collisions(recall: float) -> int:
    """The most collisions that a pair at the threshold still reaches with this probability: each window takes it with P(|normal| <= WIDTH)."""
    p = erf(WIDTH / sqrt(2))
    missed, k = 0.0, 0
    while True:
        missed += comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if missed > 1 - recall:
            return k
        k += 1


def calibrate(n: int, cosine: float, spread: float) -> Plan:
    """n vectors, whose mean squared distance from their mean is ``spread``: buckets of AIM vectors, and tables enough for TABLE_RECALL.

    A hyperplane through the mean parts a pair at the threshold with the probability angle / pi; the angle is that at the mean.
    """
    gap = sqrt(2 - 2 * cosine)
    together = 1 - acos(max(-1.0, 1 - gap * gap / (2 * max(spread, 1e-9)))) / pi
    bits = max(0, ceil(log2(max(1, n) / AIM)))
    needed = lambda b: 1 if b == 0 else ceil(log(1 - TABLE_RECALL) / log(1 - together**b)) if together**b > 1e-9 else TABLES + 1
    while needed(bits) > TABLES:
        bits -= 1
    return Plan(bits, needed(bits), WIDTH * gap, least_collisions(COUNT_RECALL))


def units(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _normal(kind: int, length: int, count: int) -> np.ndarray:
    """``count`` random directions for vectors of this length; the same in every task."""
    return np.random.Generator(np.random.PCG64([20240607, kind, length])).standard_normal((count, length))


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of the lists of a column."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[begin[rows][:, None] + np.arange(size)]))
    return out


def _moments(batches):
    """Rows (length, n, sums) of a task: how many vectors of a length it has, and the sum of their unit vectors."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for rows, values in _vectors(batch.column(0)):
            n, sums = held.get(values.shape[1], (0, 0.0))
            held[values.shape[1]] = n + len(rows), sums + units(values).sum(axis=0)
        if len(held) > LENGTHS:
            yield _moment_rows(held)
            held = {}
    yield _moment_rows(held)


def _moment_rows(held):
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], ["length", "n", "sums"])


def _code(plan: Plan, means: dict[int, np.ndarray]):
    """Adds to each vector its projections, and its bucket in each table: the signs of some more projections, centred."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            places, codes, lengths = np.zeros((n, PROJECTIONS), dtype=np.float32), np.zeros((n, plan.tables), dtype=np.int64), np.zeros(n, dtype=np.int32)
            for rows, values in _vectors(batch.column(3)):
                size = values.shape[1]
                lines, cuts = _normal(0, size, PROJECTIONS).T, _normal(1, size, plan.tables * plan.bits).T
                step = max(1, (1 << 21) // (size + plan.tables * plan.bits))
                for low in range(0, len(rows), step):
                    some, unit = rows[low : low + step], units(values[low : low + step])
                    places[some] = unit @ lines
                    signs = (unit - means.get(size, 0.0)) @ cuts > 0
                    codes[some] = signs.reshape(len(some), plan.tables, plan.bits) @ (1 << np.arange(plan.bits, dtype=np.int64))
                lengths[rows] = size
            lists = [pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32), pa.array(x.ravel())) for x, k in ((places, PROJECTIONS), (codes, plan.tables))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), *lists], ["id", "key", "n", "embedding", "length", "places", "codes"])

    return run


def links(unit: np.ndarray, places: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray | None, plan: Plan, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: pairs of a tile that pass the count and the cosine, and that no earlier table brings together.

    Each projection is sorted, and the window around each member found by bisection as a range of ranks; ranks are
    compared without a sign, so one comparison tests both ends.
    """
    n = len(unit)
    found = []
    ranks = np.empty((len(places.T), n), dtype=np.uint16)
    bounds = np.empty((2, len(places.T), n), dtype=np.uint16)
    for k, values in enumerate(places.T):
        order = np.argsort(values, kind="stable")
        ranks[k, order] = np.arange(n, dtype=np.uint16)
        ordered = values[order]
        bounds[0, k] = np.searchsorted(ordered, values - np.float32(plan.half), "left")
        bounds[1, k] = np.searchsorted(ordered, values + np.float32(plan.half), "right") - bounds[0, k]
    for low in range(0, n, QUERIES):
        high = min(n, low + QUERIES)
        met = np.zeros((high - low, n - low), dtype=np.uint8)
        for rank, begin, width in zip(ranks, bounds[0], bounds[1], strict=True):
            met += (rank[None, low:] - begin[low:high, None]) < width[low:high, None]
        i, j = np.nonzero(met >= plan.least)
        keep = i < j
        if side is not None:
            keep &= side[low + i] != side[low + j]
        i, j = i[keep] + low, j[keep] + low
        if not len(i):
            continue
        if len(i) * 8 > met.size:  # many pass: one product for all of them
            near = (unit[low:high] @ unit[low:].T)[i - low, j - low] >= cosine
        else:
            near = np.concatenate([np.einsum("ij,ij->i", unit[i[a : a + 65536]], unit[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) >= cosine
        i, j = i[near], j[near]
        fresh = np.ones(len(i), dtype=bool)
        for earlier in range(table):
            fresh &= codes[i, earlier] != codes[j, earlier]
        found.append((i[fresh], j[fresh]))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect all that these pairs connect, fewer than n."""
    label = np.arange(n)
    while True:  # labels sink to the least of each component
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(k, int(label[k])) for k in np.flatnonzero(label != np.arange(n)).tolist()]


def _compare(plan: Plan, cosine: float):
    """Rows of a tile's result: (a, key_a, links, null) for members with links, and (a, key_a, null, b) for edges that connect them."""

    def flush(held):
        whole = pa.Table.from_batches(held).combine_chunks()
        first = {c: whole[c][0].as_py() for c in ("t", "x", "y")}
        ids, keys, n, side = (whole[c].to_numpy() for c in ("id", "key", "n", "side"))
        places = whole["places"].chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        codes = whole["codes"].chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        unit = units(_vectors(whole["embedding"].chunk(0))[0][1])
        i, j = links(unit, places, codes, first["t"], side if first["x"] != first["y"] else None, plan, cosine)
        total = np.zeros(len(ids), dtype=np.int64)
        np.add.at(total, i, n[j])
        np.add.at(total, j, n[i])
        some = np.flatnonzero(total)
        out = [(int(ids[k]), int(keys[k]), int(total[k]), None) for k in some.tolist()]
        return out + [(int(ids[a]), int(keys[a]), None, int(ids[b])) for a, b in _forest(len(ids), i, j)]

    def run(batches):
        held, name = [], None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            at = 0
            while at < len(names):
                stop = at + 1
                while stop < len(names) and names[stop] == names[at]:
                    stop += 1
                if held and names[at] != name:
                    yield _link_rows(flush(held))
                    held = []
                name = names[at]
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield _link_rows(flush(held))

    return run


def _link_rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * 4)], ["id", "key", "links", "other"])


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """All columns of vectors, with n_links, component_id and kept (the vector with the least id of its component).

    Equal vectors are one, with a number. Every vector is dealt into a bucket of each of some tables, by the sides of
    hyperplanes through the mean on which it lies. In a bucket PROJECTIONS one-dimensional projections are sorted; the
    members in the window around a vector's own place collide with it there, collisions are counted for each pair, and pairs
    with enough of them are verified by cosine in double precision. ``calibrate`` chooses tables, windows and the count
    so that a pair at the threshold is missed in 1 % of cases, and nearer ones more rarely; links are never wrong.
    Buckets above TILE members are compared in tiles of two blocks each, all of them, so none is capped. A pair is
    counted in the first table that brings it together, and tiles return sums and spanning edges, never their pairs.

    A vector that is null, empty or zero, or holds a null, a NaN or an infinity, links with nothing, nor do vectors of different
    lengths. A row without id links with nothing either, has no component and is kept. Rows with the same id are one node
    with their own links; repeated rows link with each other. An empty table gives an empty result; columns of any name stay.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    given = Given(vectors)
    kind = given.table.schema[given.of(embedding)].dataType.simpleString()
    raw = given[embedding] if kind in ("array<float>", "array<double>") else given[embedding].cast("array<double>")
    plain = F.transform(raw, lambda x: x + F.lit(0).cast("float"))  # -0.0 becomes 0.0
    good = F.coalesce(raw.isNotNull() & given[vec_id].isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(raw, lambda x: x != 0), F.lit(False))
    valid = given.table.where(good).select(given[vec_id].cast("long").alias("id"), plain.alias("embedding"))
    classes = valid.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = scratch.keep(classes.select("id", F.xxhash64("embedding").alias("key"), "n", "embedding"))
    moments = classes.select("embedding").mapInArrow(_moments, "length int, n long, sums array<double>")
    sums = moments.select("length", F.posexplode("sums")).groupBy("length", "pos").agg(F.sum("col").alias("s"))
    sums = moments.groupBy("length").agg(F.sum("n").alias("n")).join(sums.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("pos", "s")))["s"].alias("sums")), "length")
    known = sums.orderBy(F.desc("n"), "length").limit(LENGTHS).collect()  # LENGTHS vectors at most
    means = {r["length"]: np.array(r["sums"]) / r["n"] for r in known}
    spread = min([1.0, *(1 - float(m @ m) for m in means.values())])
    plan = calibrate(max([0, *(r["n"] for r in known)]), cosine, spread)
    embedded = classes.schema["embedding"].dataType.simpleString()
    coded = classes.mapInArrow(_code(plan, means), f"id long, key long, n long, embedding {embedded}, length int, places array<float>, codes array<long>")
    coded = scratch.keep(coded)
    scratch.drop(classes)
    found = []
    for begin in range(0, plan.tables, TURN):
        found.append(scratch.keep(_turn(coded, begin, plan, cosine, scratch)))
        scratch.sweep()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    component = connected_components(every.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    counted = every.where("links is not null").groupBy("id", "key").agg(F.sum("links").alias("links"))
    check = lambda v: F.xxhash64(F.lit(7), v)  # noqa: E731  with key, 128 bits of a vector
    info = coded.select("id", "key", "n", check(F.col("embedding")).alias("check")).join(counted, ["id", "key"], "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    info = info.select("key", "check", F.col("id").alias("least"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"), "n")
    info = scratch.keep(info.where("n > 1 or links > 0 or component <> least").select(F.col("key").alias("k"), F.col("check").alias("c"), "links", "component"))
    # rows that can't link are spread over many keys that no vector has
    rows = given.table.withColumn("own", given[vec_id].cast("long")).withColumn("key", F.when(good, F.xxhash64(plain)).otherwise(F.monotonically_increasing_id()))
    rows = rows.withColumn("check", F.when(good, check(plain)))
    out = rows.join(info, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")), "left")
    out = out.withColumn("links", F.coalesce("links", F.lit(0)).cast("long")).withColumn("component", F.coalesce("component", "own"))
    return given.back(out, n_links="links", component_id="component", kept=F.coalesce(F.col("own") == F.col("component"), F.lit(True)))


def _turn(coded: DataFrame, begin: int, plan: Plan, cosine: float, scratch: Scratch) -> DataFrame:
    """What the next TURN tables find."""
    tables = F.array(*(F.lit(t) for t in range(begin, min(plan.tables, begin + TURN))))
    code = lambda t: F.element_at("codes", t + 1)
    thin = coded.select("length", F.explode(tables).alias("t"), "codes").select("length", "t", code(F.col("t")).alias("code"))
    large = thin.groupBy("length", "t", "code").agg(F.count("*").alias("m")).where(F.col("m") > TILE)
    large = scratch.keep(large.select("length", "t", "code", F.ceil(F.col("m") / (TILE // 2)).alias("blocks")))
    many = large.count()
    rows = coded.select(F.explode(tables).alias("t"), "length", "id", "key", "n", "places", "codes", "embedding").withColumn("code", code(F.col("t")))
    if many > LARGE:
        rows = rows.withColumn("share", F.pmod("key", F.lit(SHARES)))
        shared = large.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).cast("long"))
        rows = rows.join(shared, ["length", "t", "code", "share"], "left").drop("share")
    elif many:
        rows = rows.join(F.broadcast(large), ["length", "t", "code"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("long"))
    blocks: Column = F.coalesce("blocks", F.lit(1))
    side = F.pmod(F.xxhash64("key", "id"), blocks)
    rows = rows.withColumn("side", side).withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    names = ["length", "t", "code", "x", "y"]
    dealt = rows.select("length", "t", "code", F.least("side", "z").alias("x"), F.greatest("side", "z").alias("y"), "side", "id", "key", "n", "places", "codes", "embedding")
    return dealt.repartition(*names).sortWithinPartitions(*names, "id", "key").mapInArrow(_compare(plan, cosine), "id long, key long, links long, other long")
