"""The corpus pipeline: documents to packed token sequences, in stages that each write Parquet for the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but the last return the
columns of documents. Rows are judged by the operators' own rules for nulls, empty and repeated rows (see each operator).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm import decontaminate, jaccard, language, packing, substrings
from cardmill.llm.queries import HELD_OUT
from cardmill.llm.tables import crc_fold, join_ids, materialize, table

CAPACITY = 4096


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on; those that are null, empty or without a letter are rejected."""
    model = language.train(docs.where(crc_fold(F.col("doc_id")) != HELD_OUT))
    found = language.identify(docs, model)
    # without any labelled document nothing is learned, and only the letters can tell
    told = F.col("lang_pred") != language.UNKNOWN if model.languages else F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    return found.where(told).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest doc_id; rows are judged one by one, whatever
    ids they repeat, and of equal ids the text with the smallest hash stays. Rows without an id come after all others."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    found = jaccard.near_duplicates(rows, key="__row", width=5, threshold=75)
    found = materialize(found.select(F.col("doc_id").alias("__row"), "component_id"))
    # only rows in groups of two and more are compared
    several = materialize(found.groupBy("component_id").count().where("count > 1").select("component_id"))
    members = materialize(join_ids(found, several, ["component_id"], "left_semi"))
    ids = join_ids(rows, members.select("__row"), ["__row"], "left_semi").select("__row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("place"))
    members = materialize(members.join(ids, "__row"))
    firsts = members.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.__row").alias("__row"))
    gone = members.select("__row").join(firsts, "__row", "left_anti")
    return join_ids(rows, gone, ["__row"], "left_anti").drop("__row")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; a document that loses all its words goes."""
    found = substrings.deduplicate(docs, window=50)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item are rejected."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and their place in it."""
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY, end_id=1, with_ids=False)
    return packing.pack(found, capacity=CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # language, near duplicates and tokens are beyond SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
