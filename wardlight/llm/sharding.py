"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact size."""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import Given


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good. Above numpy's range: ratio of uniforms with the tails cut far out (Stadlober 1990)."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good and bad else min(draws, good) if not bad else 0
    total = good + bad
    mean = draws * (good / total)
    spread = math.sqrt(max(mean * (bad / total) * ((total - draws) / max(1, total - 1)), 1e-9) + 0.5)
    low, high = max(0, draws - bad), min(draws, good)
    centre, width = mean + 0.5, 1.7155277699214135 * spread + 0.8989161620588988
    log_p = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))
    peak = log_p(min(high, max(low, (draws + 1) * (good + 1) // (total + 2))))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - peak:
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row p, column s: how many rows partition p sends to shard s, if all rows are dealt at random into shards of these sizes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = list(sizes), []
    for n in counts:
        rest, row = sum(left), []
        for s in range(len(left)):
            rest -= left[s]
            got = _hypergeometric(rng, left[s], rest, n)
            row.append(got)
            n -= got
            left[s] -= got
        out.append(row)
    return out


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 29, rows_a_block: int = 4096, most_blocks: int = 16_384) -> DataFrame:
    """All columns of docs that don't clash, with shard (0 to n_shards - 1) and slot (0, 1, ... in each shard, in random order).

    Shard sizes differ by one row at most. Documents fall by hash into blocks; the count of each block is all that the
    driver gets (``most_blocks`` numbers at most), and from these it draws the matrix of exact block-to-shard counts.
    Each block is put in random order and dealt by its row of the matrix; rows go to their shard and are put in random
    order again. For that a shard falls by a second hash into pieces, which are ordered each on its own and stand one
    after the other by their counts, so no window holds a whole shard.

    The hash takes doc_id and all other columns that Spark can hash, so reruns agree and rows without doc_id spread; rows that agree in all
    columns share a block and may swap places. Any text, null, empty or very long, is dealt alike; an empty table gives an empty
    result. Columns named shard and slot are replaced, further ones of any name are kept.
    """
    given = Given(docs)
    plain = [f.name for f in given.table.schema.fields if not re.search("map<|variant", f.dataType.simpleString()) and f.name in given.kept("shard", "slot")]
    content = F.xxhash64(*plain)
    names = F.concat(F.coalesce(given["doc_id"].cast("string"), F.lit("")), F.lit(":"), content.cast("string"))
    key = lambda salt: F.md5(F.concat(names, F.lit(f":{salt}:{seed}")))
    number = lambda hexed: F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")
    n = docs.count()
    n_blocks = min(most_blocks, max(1, -(-n // rows_a_block)))
    a_shard = max(1, -(-n // (n_shards * rows_a_block)))
    block = (number(key("block")) % n_blocks).cast("int")
    found = {r["block"]: r["count"] for r in given.table.groupBy(block.alias("block")).count().collect()}
    shard_sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([found.get(b, 0) for b in range(n_blocks)], shard_sizes, seed)
    ends = [np.cumsum(row).tolist() for row in matrix]

    table = docs.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<long>>")).alias("b", "ends"))
    rows = given.table.withColumn("block", block).withColumn("first", key("first")).withColumn("second", key("second"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("first", "second")))
    rows = rows.join(F.broadcast(table), F.col("block") == F.col("b"))  # most_blocks rows at most
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    rows = rows.withColumn("piece", F.floor(number(F.col("second")).cast("double") / 2.0**32 * a_shard).cast("int")).drop("block", "first", "rank", "b", "ends")
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("many"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    ahead = counts.select(F.col("shard").alias("s"), F.col("piece").alias("k"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("second")) - 1
    rows = rows.withColumn("place", place).join(ahead, (F.col("shard") == F.col("s")) & (F.col("piece") == F.col("k")))
    return given.back(rows, shard=F.col("shard").cast("int"), slot=(F.col("ahead") + F.col("place")).cast("long"))
