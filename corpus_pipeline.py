"""Documents to training ids in five stages; each works on all that the one before it kept.

quality: what the base rules or the likelihood ratio reject goes. near_duplicates: of each group
of linked documents the smallest doc_id stays (rows of one doc_id stay or go together; rows
without a doc_id stay). decontaminate: documents that cover a benchmark item go. secrets: findings
are replaced in the texts. encode: texts become token ids; a null text becomes none.

All stages but the last return the columns of documents, in their order, whatever further columns
these have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import byte_bpe, jaccard, quality, secrets, tiling
from tessella.llm.runtime import pack, remove, table, unpack, work_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpack(quality.judge(pack(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = jaccard.join_documents(docs)
    gone = joined.where("doc_id != component_id").select("doc_id").distinct()
    return unpack(pack(docs).join(gone, "doc_id", "left_anti"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpack(tiling.find_leaks(pack(docs), table(spark, sf_dir, "benchmark")).where("size(leaks) = 0"), docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.standing_ledger(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # The workers of the stages before keep their memory, so fewer states are kept here.
    made = byte_bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, kept=60_000)
    return made.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("remove_secrets", remove_secrets),
    ("encode", encode),
]
#: SQL can't express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = work_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)  # nothing reads it any more
        before = at
    return docs
