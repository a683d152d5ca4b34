"""The operators' queries over the test tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.llm import binout, common, filteraudit, licenses, merkle, mixing, ngramjoin, packing, quality, simhash, substring, tokencount, topk, urls
from agendum.llm.common import table
from agendum.llm.oracle import ORACLE  # noqa: F401
from agendum.llm.tokens import vocabulary


def op1_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), "mix_epoch", "mix_block", "mix_place")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "records")
    binout.write_records(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return binout.read_records(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


URL_RULES = [
    urls.UrlRule("allow", "org", "/"), urls.UrlRule("block", "example.org", "/es/"), urls.UrlRule("block", "example.org", "/en/1"),
    urls.UrlRule("allow", "com", "/fr/"), urls.UrlRule("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    pieces = packed.pieces.select("piece_uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packed.placement, "piece_uid").drop("piece_uid")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filteraudit.audit(filteraudit.failing_rows(docs, table(spark, sf_dir, "labels")), ["A", "B", "C", "D", "E"])


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    now = {"text": F.when(touched, common.ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=now)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ball_tree_top_k, op2_temperature_mix, op3_license_scan, op4_token_records, op5_token_counts,
        op6_url_filter, op7_best_fit_packing, op8_ngram_jaccard, op9_quality_rules, op10_substring_dedup,
        op11_filter_audit, op12_simhash_components, op13_merkle_manifest,
    )
}


