"""From raw documents to training shards in five stages, each an operator of wardlight.llm.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. ``run`` writes each stage's rows
as Parquet in the shared folder and reads them again. Every stage takes texts of any length whole, gives an empty table for
an empty one, and keeps further columns whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import decontaminate, jaccard, langid, mixing, sharding, store
from wardlight.llm.columns import Given

#: Near copies: words of a shingle, and percent of similarity.
SIZE, PERCENT = 5, 80
#: Documents whose best language has less of the probability are rejected.
LEAST_SCORE = 0.35
ORACLE_SQL = None  # a trained network decides in the first stage


def _neutral(docs: DataFrame) -> tuple[Given, DataFrame]:
    """docs under neutral names, with the columns that operators read in front."""
    given = Given(docs)
    named = [given[c].alias(c) for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return given, given.table.select(*given.inner, *named)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: texts that are null or without a letter, and those that fit no learned language, go.

    Rows with a null lang are judged and not learned from; if no row has a lang, none can be judged and all go. Of equally
    probable languages any counts; repeated rows are judged alike; other nulls don't matter.
    """
    given = Given(docs)
    rows = given.table.withColumnRenamed(given.of("text"), "text")  # each text goes to the network once
    named = langid.identify(rows, langid.fit(docs.select("doc_id", "text", "lang")))
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return given.back(kept.withColumnRenamed("text", given.of("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component; rows without doc_id can't be named and stay.

    A null or empty text is linked with nothing and stays. Of several rows with that doc_id the one whose text, and then whose whole
    row by hash, comes first stays.
    """
    found = jaccard.jaccard_components(docs, size=SIZE, percent=PERCENT)
    ids = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.col("doc_id").alias("keep"), "n")
    given, rows = _neutral(docs)
    rows = rows.withColumn("key", F.col("doc_id").cast("long")).select(*given.inner, "text", "key")
    joined = rows.join(ids.hint("shuffle_hash"), F.col("key") == F.col("keep"))  # shuffled whatever the size of ids
    kept = [joined.select(*given.inner), rows.where("key is null").select(*given.inner)]
    if not ids.where("n > 1").isEmpty():  # ids that several rows have
        plain = [f.name for f in given.table.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        first = F.min_by(F.struct(*given.inner), F.struct("text", F.xxhash64(*plain)))
        kept[0] = joined.where("n = 1").select(*given.inner).unionByName(joined.where("n > 1").groupBy("key").agg(first.alias("r")).select("r.*"))
    return given.back(kept[0].unionByName(kept[1]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in which a benchmark window occurs, also one without doc_id; rows with equal texts share their lot.

    A null or empty text stays; an empty benchmark drops nothing.
    """
    given, rows = _neutral(docs)
    found = decontaminate.find_contamination(rows.select(F.xxhash64("text").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("bad")).distinct()
    return given.back(rows.join(bad, F.xxhash64("text") == F.col("bad"), "left_anti"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those that it doesn't take go.

    A null or empty text has no words and goes; a null source is one of its own; rows with the same doc_id and text are taken alike.
    """
    given, rows = _neutral(docs)
    mixed = mixing.mix_sources(rows).where("repeats > 0")
    return given.back(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, in place of columns with these names. Any nulls are dealt as they are; rows that agree in all columns may swap places."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards made of the table documents of sf_dir. What a stage has written on its way is deleted once its rows are stored."""
    scratch = store.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        begun = len(store.LIVE)
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        store.release(begun)
        scratch.drop(before)
    return docs
