"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytofold.llm import decontamination, embedding_dedup, filter_audit, line_dedup, minhash_dedup, packing, periodic_runs, personal_data, quality, suffix_dedup, token_counts, toxicity, warc
from cytofold.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda spark, sf: decontamination.digest(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark")),
        "op2_toxicity": lambda spark, sf: toxicity.digest(spark, table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op3_warc_revisits": lambda spark, sf: warc.digest(spark, table(spark, sf, "pages")),
        "op4_embedding_dedup": lambda spark, sf: embedding_dedup.digest(spark, table(spark, sf, "embeddings")),
        "op5_packing": lambda spark, sf: packing.digest(spark, table(spark, sf, "documents"), tokenizer_path()),
        "op6_token_counts": lambda spark, sf: token_counts.digest(spark, table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model")),
        "op7_quality": lambda spark, sf: quality.digest(spark, table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op8_minhash_dedup": lambda spark, sf: minhash_dedup.digest(spark, table(spark, sf, "documents")),
        "op9_suffix_dedup": lambda spark, sf: suffix_dedup.digest(spark, table(spark, sf, "documents")),
        "op10_line_dedup": lambda spark, sf: line_dedup.digest(spark, table(spark, sf, "documents")),
        "op11_personal_data": lambda spark, sf: personal_data.digest(spark, table(spark, sf, "documents")),
        "op12_periodic_runs": lambda spark, sf: periodic_runs.digest(spark, table(spark, sf, "documents")),
        "op13_filter_audit": lambda spark, sf: filter_audit.digest(spark, table(spark, sf, "documents"), table(spark, sf, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisits": warc.SQL, "op4_embedding_dedup": embedding_dedup.SQL, "op8_minhash_dedup": minhash_dedup.SQL, "op10_line_dedup": line_dedup.SQL, "op13_filter_audit": filter_audit.SQL}
