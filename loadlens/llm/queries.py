"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import bpe, chunks, conversations, decontaminate, lm, minhash, pii, quality, spelling, suffix, tokenfiles, \
    tokens, warc
from loadlens.llm.oracles import ORACLE_SQL
from loadlens.llm.tables import read, shared_folder


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "op1-warc")
    warc.write_archives(warc.plan_records(read(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path, payloads=False).drop("url", "payload")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), BYTE_BPE)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "op3-shards")
    tokenfiles.write_shards(read(spark, sf_dir, "documents"), WORD_BPE, path, end_id=1)
    return tokenfiles.read_documents(spark, path)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_digests(read(spark, sf_dir, "documents"))


def op7_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_chunks(read(spark, sf_dir, "documents"))


def op7_united_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_chunks(read(spark, sf_dir, "documents"), tables=chunks.UNITED)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(read(spark, sf_dir, "documents"), WORD_BPE)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed", "kept", "anomaly")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.word_forms(spelling.damaged_words(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_lm_scores": op4_lm_scores,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_content_chunks": op7_content_chunks,
    "op7_united_chunks": op7_united_chunks,
    "op8_decontamination": op8_decontamination,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_quality_rules": op10_quality_rules,
    "op11_personal_data": op11_personal_data,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
