"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, mixing, near_dup, piece_tokens, prefix_trie, quality_rules, secret_scan, site_quality, spelling, substring_dedup, toxicity, warc_zip
from .oracle import ORACLE_SQL
from .session import delete_folder, shared_folder

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept", "failed")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts, and the languages of a source for its paths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("path"))
    return site_quality.judge(docs, site_quality.train(docs, table(spark, sf_dir, "labels")))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("node") == F.col("class_id")).alias("kept"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_zip.archive_folder(spark)
    archives = warc_zip.write_archives(table(spark, sf_dir, "pages"), folder)
    read = warc_zip.read_archives(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").checkpoint()
    delete_folder(spark, folder)
    return read


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a stored ledger: the earlier half of the ids, then the whole table, of which only the rest is scanned."""
    docs = table(spark, sf_dir, "documents")
    ledger = secret_scan.LedgerTable(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("id")).first()["id"]
    ledger.append(docs.where(F.col("doc_id") <= F.lit(middle)))
    found = secret_scan.by_version(docs, ledger.append(docs)).checkpoint()
    delete_folder(spark, ledger.folder)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt_paths(table(spark, sf_dir, "conversations")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's file is read by the driver alone; its pieces go to the executors."""
    import public_tokenizers

    pieces = piece_tokens.load(public_tokenizers.path("piece_bpe_32k.model"))
    tokens = piece_tokens.decode(piece_tokens.encode(table(spark, sf_dir, "documents"), pieces), pieces)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scan, op3_site_quality, op4_near_dup, op5_warc_zip,
        op6_secret_scan, op7_toxicity, op8_mixing, op9_substring_dedup, op10_decontaminate,
        op11_prefix_trie, op12_spelling_variants, op13_piece_tokens,
    )
}
