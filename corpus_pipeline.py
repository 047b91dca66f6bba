"""A corpus pipeline from the training-data operators: ``run`` applies STAGES to the documents table in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet to the shared folder and
reread as the next stage's documents, so a lost executor costs at most one stage's tasks. All stages but the last
return the columns of the documents:

1. quality rules: documents that the rules reject go;
2. MinHash near-duplicates (five-word shingles, similarity 0.8 and more): one document of each group stays;
3. suffix arrays: repeated strings of 100 bytes are cut out of the texts, ``n_chars`` follows;
4. decontamination: documents with a benchmark passage go;
5. BPE: doc_id, n_tokens, the token ids (little-endian uint32) and the decoded text in the tokenizer's notation.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns: as each operator's module states; no
stage fails on them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import bpe, decontaminate, minhash, quality, suffix
from loadlens.llm.tables import materialise, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe_codec", bpe_codec),
]

#: The stages are not expressible in SQL; tests/llm compares them with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
