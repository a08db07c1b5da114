"""A training corpus from the documents: rules, classifier, line dedup, near duplicates, packing.

Each stage reads what its predecessor kept, written as Parquet in between, and its decisions take
effect in what it returns. All but the last return the columns of documents. `docs` is a scan of Parquet files, whose
rows have the same numbers in every read. Stages decide on rows, never on ids, so null and repeated ids are rows like any
others, and so are repeated rows; columns beside those of documents, of any name, are passed on. An empty table stays one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import line_dedup, near_dup, packing, quality_classifier, quality_rules
from tallybrook.llm.common import saved, settled, tokenizer_path, with_row_id

WITH_WORDS = r"[^\x20\x09-\x0D]"


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, a table scan, whose numbers are in kept."""
    return with_row_id(docs, "_row").join(kept.select(F.col("row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source. Null and empty texts fail; null languages
    and sources are groups like any others."""
    return _only(docs, quality_rules.quality_rules(docs).where("kept"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of predicted quality 1. It learns from the labelled rows among those that are left; without any, every row stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _only(docs, quality_classifier.classify(docs, labels).where("predicted = 1"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines of later copies. Rows of which every word was a later copy's go with their lines; null texts stay."""
    cleaned = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed_lines") == 0) | F.col("text").rlike(WITH_WORDS)
    return cleaned.where(F.coalesce(left, F.lit(True))).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, at a similarity of 0.8 of five-word shingles: that of the smallest id, null ids last.
    Rows without shingles, of null or empty texts, are components of their own."""
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")
    return _only(docs, saved(near_dup.near_duplicates(docs).groupBy("root").agg(first), "firsts"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all rows, with their places in sequences of 2,048 tokens; null texts are the end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the robust estimates nor the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way, and its predecessor's rows, go when its own are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = settled(partial(stage, spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            last.drop()
        docs, last = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
