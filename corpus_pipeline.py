"""Corpus pipeline over ``documents``: five stages, each one operator of the subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``; n_chars follows the text where a stage changes it.

All stages judge rows, not ids: rows without doc_id, or several with one, are documents
of their own.  Extra columns, whatever their names, are handed on (the last stage leaves
them out), and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, near_dedup, packing, quality, substring
from tessella.llm.queries import tokenizer_path
from tessella.llm.shared import cut, has_checkpoint_dir, table, unused
from tessella.llm.substring import row_key


#: Word-shingle sets as similar as this, in per cent, are near copies of each other (op1 has a threshold of its own).
SIMILAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts, and texts without a word, score 0 and go; a text of any length
    is judged whole; repeated rows have one score and stay or go together; without
    labels to learn from every text with a word scores the share of good ones.
    """
    return quality.filter_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id (none comes last), ties by a hash of the text.

    Of repeated rows (same doc_id and text) one stays.  Null and empty texts, and texts
    without a word, are alike to nothing: all their rows stay, but for repeated ones.
    """
    row, one = unused(docs, "_row"), unused(docs, "_one")
    keyed = docs.withColumn(row, row_key())
    groups = near_dedup.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), percent=SIMILAR)
    per_row = groups.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("times"))
    ids = keyed.groupBy(F.col(row).alias("row")).agg(F.min("doc_id").alias("id"))
    first = per_row.join(ids, "row").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "times")).alias("least"))
    stays = cut(first.select(F.col("least.row").alias(one), "least.times"))

    def kept(some: str) -> DataFrame:
        return keyed.join(stays.filter(some).select(one), F.col(row) == F.col(one), "left_semi")

    return kept("times = 1").unionByName(kept("times > 1").dropDuplicates([row])).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a document of which nothing is left goes too.

    Null and empty texts, and texts shorter than a window, stay as they are; in a text
    that loses words the others are joined by one space; of repeated rows (there are
    none behind the stage before) no window is left.
    """
    words, removed = unused(docs, "n_words"), unused(docs, "n_removed")
    left = substring.remove_repeats(docs, counts=(words, removed))
    left = left.filter((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        chars = F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go.

    Each row is judged by its own text, so repeated rows stay or go together; null and
    empty texts stay, and null or empty items occur nowhere.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences.

    A null or empty text is one piece of the end id; a long one is cut into pieces;
    repeated rows, and rows without doc_id, are packed each.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", one_of_each),
    ("substring", without_repeats),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: A trained classifier and a packing order are no SQL; tests/llm/test_pipeline.py holds each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again; of a stage that is read no more nothing is left there."""
    root = f"{has_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        where = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = where
    return docs
