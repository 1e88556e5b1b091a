"""One query per operator, over whole tables, and the same results in DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm import bit_slices, decontaminate, jaccard, language, licenses, packing, phrases, prefix_trie, quality, sharding, substrings, url_filter, warc
from cardmill.llm.tables import crc_fold, table
from cardmill.session import work_dir

HELD_OUT = 2  # the fold of documents that language identification does not learn from


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "identifiers", "n_sentences", "n_matches", "licenses")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"))
    model = language.train(docs.where(fold != HELD_OUT))
    held_out = F.coalesce(fold == HELD_OUT, F.lit(False))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    one_blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(one_blank, 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=5, threshold=75)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=False)
    return packing.pack(found, capacity=4096)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.contiguous_shards(docs, ["doc_id", "text_crc32"], "size", 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    found = warc.page_captures(warc.captures(warc.read_records(spark, folder, with_payload=False)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def op13_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_top_vectors": op13_top_vectors,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op7_quality_rules": quality.oracle(),
    "op11_collocations": phrases.oracle(),
    "op12_prefix_trie": prefix_trie.oracle(),
    "op13_top_vectors": bit_slices.oracle(),
}
