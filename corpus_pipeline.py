"""The corpus pipeline: reject poor and toxic documents, keep one of each near copies, cut benchmark text, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that
is written as Parquet and read again for the next stage. All but the last return the columns of documents.

Defined results: null and empty texts are judged and packed like others. Labels teach the two classifiers from the
whole documents table of sf_dir, whatever rows the stage gets; held-out rows teach nothing. Of a class of near copies
the row with the smallest id stays (of several such rows one; rows without an id only if no other is there). A document of which decontamination leaves no word is
dropped, one that it cuts gets its new length as n_chars. Empty tables pass through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm.batches import fresh
from flowsentry.llm.decontaminate import remove_hits
from flowsentry.llm.nearcopies import near_copies, text_key
from flowsentry.llm.packing import pack
from flowsentry.llm.quality import fit_quality, keep_good
from flowsentry.llm.queries import TOKENIZER, read
from flowsentry.llm.toxicity import fit_toxicity, keep_civil
from flowsentry.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, fit_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return keep_civil(docs, fit_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    no_id = F.col("doc_id").isNull()
    best = F.min(F.struct(no_id.alias("without"), F.col("doc_id").alias("id"), F.col("text_key").alias("own")))
    kept = near_copies(docs, keys=True).groupBy("class_key").agg(best.alias("best")) \
        .select("best.own", "best.without", F.coalesce("best.id", F.lit(0)).alias("place"))
    key = ["own", "without", "place"]
    rows = docs.select(F.struct("*").alias("row"), text_key("text").alias("own"), no_id.alias("without"),
                       F.coalesce("doc_id", F.lit(0)).alias("place"))
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark windows cover."""
    before = fresh(docs, "before")
    cut = remove_hits(docs.withColumn(before, F.xxhash64("text")), read(spark, sf_dir, "benchmark"))
    changed = ~F.col(before).eqNullSafe(F.xxhash64("text"))
    has_word = F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    length = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.filter(~changed | has_word).withColumn("n_chars", length).drop(before)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

# Classifiers, signatures and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
