"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.byte_bpe import op9
from tessella.llm.centroids import op11, op11_sql
from tessella.llm.chat import OP7_SQL, op7
from tessella.llm.codebooks import op12, op12_sql
from tessella.llm.hamming import OP13_SQL, op13
from tessella.llm.jaccard import OP5_SQL, op5
from tessella.llm.piece_counts import op10
from tessella.llm.quality import op2
from tessella.llm.secrets import OP1_SQL, op1
from tessella.llm.suffix_dedup import OP3_SQL, op3
from tessella.llm.tiling import op6
from tessella.llm.url_rules import OP8_SQL, op8
from tessella.llm.warc import OP4_SQL, op4


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ledger": op1,
        "op2_quality": op2,
        "op3_suffix_dedup": op3,
        "op4_warc": op4,
        "op5_jaccard": op5,
        "op6_benchmark_tiling": op6,
        "op7_chat_format": op7,
        "op8_url_rules": op8,
        "op9_byte_bpe": op9,
        "op10_token_counts": op10,
        "op11_centroid_clusters": op11,
        "op12_vector_codes": op12,
        "op13_embedding_duplicates": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_ledger": OP1_SQL,
        "op3_suffix_dedup": OP3_SQL,
        "op4_warc": OP4_SQL,
        "op5_jaccard": OP5_SQL,
        "op7_chat_format": OP7_SQL,
        "op8_url_rules": OP8_SQL,
        "op11_centroid_clusters": op11_sql(),
        "op12_vector_codes": op12_sql(),
        "op13_embedding_duplicates": OP13_SQL,
    }
