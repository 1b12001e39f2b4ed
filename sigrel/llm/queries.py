"""One query for each training-data operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, language, license_scan, line_dedup, prefix_trie, secrets, spelling, toxicity
from .common import Tables, held_out, table
from .jaccard_join import jaccard_groups
from .mixing import mix_sources
from .quality import quality_rules


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out("doc_id"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.read_back(chat.format_turns(given.unionByName(more)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "model")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_words", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), "leaked_items")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs, learn=~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.nearest").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(spelling.corpus_words(docs, min_chars=6, min_count=5, damaged=199), ratio=5)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_ids(encoded.drop("text"), vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = Tables(spark).put(prefix_trie.hashed_turns(conversations))
    return prefix_trie.prefix_trie(prefix_trie.branched(turns, every=20, heads=4), turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_source_mix, op3_chat_format, op4_jaccard_join, op5_secret_scan, op6_line_dedup, op7_decontaminate, op8_quality_rules, op9_license_scan, op10_language_id, op11_spelling_variants, op12_byte_bpe, op13_prefix_trie)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op2_source_mix": sql.SOURCE_MIX, "op3_chat_format": sql.CHAT_FORMAT, "op4_jaccard_join": sql.JACCARD_JOIN, "op8_quality_rules": sql.QUALITY_RULES, "op11_spelling_variants": sql.SPELLING_VARIANTS, "op13_prefix_trie": sql.PREFIX_TRIE}
