"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import read
from . import bpe, decontaminate, html_extract, language_id, line_dedup, near_dedup, quality_rules, repeats, token_counts, warc


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~fold & F.col("doc_id").isNotNull()))
    return language_id.predict(docs.select("doc_id", "text", fold.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return done.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    digest = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return done.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those removed as boilerplate, and a digest of what is left."""
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe_encode_decode": op10_bpe_encode_decode,
}
