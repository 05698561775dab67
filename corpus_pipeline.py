"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the docs of the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm.common import on_workers, stored
from threadloom.llm.decontaminate import mark_contaminated
from threadloom.llm.language import UNDETERMINED, identify, lettered, training_texts
from threadloom.llm.packing import pack
from threadloom.llm.pii import replace_pii
from threadloom.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = "threadloom surrogates"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter in it) go; a missing label is filled by the prediction."""
    training = training_texts(docs)
    # where nothing was learned all texts are undetermined
    told = identify(docs, training, keep=COLUMNS).filter(F.col("lang_pred") != UNDETERMINED if training else lettered("text"))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays.

    Only ids decide and are joined back; the side of the ids is hashed, so texts
    are shuffled once and not sorted. Where a kept id stands on several rows,
    its different texts stay; rows without an id cannot name a group, of them
    each different text stays once.
    """
    groups = near_duplicates(docs)
    kept = stored(groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept-ids")
    several = kept.filter("rows > 1")
    rows = docs.select(*COLUMNS)
    parts = [rows.join(kept.filter("rows = 1").hint("shuffle_hash"), "doc_id", "left_semi")]
    if not several.isEmpty():
        parts.append(rows.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    nameless = rows.filter("doc_id IS NULL")
    if not nameless.isEmpty():
        parts.append(nameless.dropDuplicates(["text"]))
    return reduce(DataFrame.unionByName, parts)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark_contaminated(docs, items, keep=COLUMNS, drop=True).select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts get surrogates; n_chars follows the text."""
    return replace_pii(docs, KEY, keep=COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document placed in a sequence."""
    return pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminated", decontaminated), ("without_pii", without_pii), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a scale folder."""
    docs = on_workers(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"stage-{name}")
    return docs
