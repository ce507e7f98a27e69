"""Mixing of sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import Given
from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size): a budget of ``share`` times all sizes, dealt by weight.

    Weights repeat over the sources in code-point order, a null source last. No target exceeds ``most`` times the
    source's size; what is above goes to the others by weight. Sorted by the level at which each source is full, the
    level of the rest follows from two running sums, so no iteration is needed. One row a source is all that meets in the
    windows here; a null source is one; equal levels go by source; an empty table gives an empty result.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    t = t.withColumn("budget", F.sum("source_size").over(all_rows).cast("double") * share)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(all_rows))
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"), "budget")


def _place(name: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in its source's queue in this round: hex digits of a hash, so that reruns agree."""
    return F.md5(F.concat(name, F.lit(":"), epoch.cast("string"), F.lit(f":{seed}")))


def _name(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: id and text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, rows_a_bucket: int = 4096, size: Column | None = None) -> DataFrame:
    """All columns of docs that don't clash, with size, source_size, target and repeats: how often the mix takes the document.

    Each source is a queue of shuffled documents, repeated ``most`` times in other orders. A document's finish time is
    the number of its source's words up to its end, divided by the source's target. All queues merge by finish time, and
    the merged line is cut before it exceeds the budget. In each source a prefix of its queue is taken, so one
    place for each source says which documents are in: the texts themselves are never shuffled.

    No window holds a whole source. Places are hash values, so a queue falls into ranges of about ``rows_a_bucket``
    rows; sums of ranges give their offsets, and likewise ranges of the finish time lead to the one that holds the cut. A
    window over the ranges themselves has one row for each ``rows_a_bucket`` rows of a source, or of all.

    Size is the word count of ``text`` if ``size`` (columns of docs) is not given. A null or empty text has size 0 and is
    never repeated; a null source is a source of its own; rows with the same doc_id and text in a source are taken together,
    a null doc_id counting as an id, so a source comes as near its target as its largest group of such rows allows; a text of any length
    counts whole; an empty table gives an empty result. Columns with the names of added ones are replaced, further ones of
    any name are kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = word_count(F.col("text")) if size is None else size
    given = Given(docs.withColumn("size", size))
    given_size = given["size"]
    name = _name(given["doc_id"], given["text"] if "text" in given.names else F.lit(""))
    thin = scratch.keep(given.table.select(given["source"].alias("source"), name.alias("name"), given_size.alias("size")).groupBy("source", "name").agg(F.sum("size").alias("size")))
    counts = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = scratch.keep(source_targets(counts.select("source", "source_size"), weights, share, most))
    ranges = counts.select(F.col("source").alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("n") / rows_a_bucket)).alias("n_ranges"))

    line = thin.where("size > 0").join(ranges, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    line = line.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("place", _place(F.col("name"), F.col("epoch"), seed))
    line = line.withColumn("range", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("n_ranges")))
    sums = line.groupBy("source", "epoch", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("range").alias("_r"), "ahead")
    inside = Window.partitionBy("source", "epoch", "range").orderBy("place", "name").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("upto", F.sum("size").over(inside))
    line = line.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("range") == F.col("_r")))
    goal = targets.select(F.col("source").alias("_g"), "target", "budget")
    line = line.join(goal, F.col("source").eqNullSafe(F.col("_g"))).where("target > 0")
    line = scratch.keep(line.select("source", "epoch", "place", "name", "size", "budget", ((F.col("ahead") + F.col("upto")) / F.col("target")).alias("finish")))

    n_slices = max(1, -(-line.count() // rows_a_bucket))
    line = line.withColumn("slice", F.floor(F.col("finish") * n_slices))
    totals = line.groupBy("slice").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    sofar = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("sofar", F.sum("words").over(sofar))
    cut = totals.where("sofar > budget").agg(F.min(F.struct("slice", (F.col("sofar") - F.col("words")).alias("before"))).alias("c")).first()["c"]
    if cut is None:
        taken = line
    else:
        merged = Window.orderBy("finish", F.col("source").isNull(), "source", "epoch", "place", "name").rowsBetween(Window.unboundedPreceding, 0)
        edge = line.where(F.col("slice") == cut["slice"]).withColumn("total", F.sum("size").over(merged) + cut["before"])
        taken = line.where(F.col("slice") < cut["slice"]).unionByName(edge.where("total <= budget").drop("total"))
    last = taken.groupBy("source").agg(F.max(F.struct("epoch", "place", "name")).alias("last"))
    plan = targets.join(last.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l")), "left")
    plan = scratch.keep(plan.select(F.col("source").alias("p"), "source_size", "target", "last"))
    scratch.drop(*[t for t in scratch.held if t is not plan])

    rows = given.table.withColumn("name", name).join(plan, given["source"].eqNullSafe(F.col("p")), "left")
    rounds = [F.struct(F.lit(e).alias("epoch"), _place(F.col("name"), F.lit(e), seed).alias("place"), F.col("name")) <= F.col("last") for e in range(1, most + 1)]
    repeats = F.coalesce(sum((F.when(given_size > 0, r.cast("int")).otherwise(0) for r in rounds), F.lit(0)), F.lit(0))
    return given.back(rows, size=given_size, source_size="source_size", target="target", repeats=repeats)
