"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm.bpe_reuse import op6_bpe_round_trip
from readloom.llm.cross_tokens import op11_cross_tokens
from readloom.llm.html_text import op1_html_extraction
from readloom.llm.line_dedup import OP10_SQL, op10_line_dedup
from readloom.llm.media import op4_media_columns
from readloom.llm.merkle import OP13_SQL, op13_merkle_manifest
from readloom.llm.mixing import OP12_SQL, op12_source_mix
from readloom.llm.packing import op8_best_fit_packing
from readloom.llm.simhash import op5_simhash
from readloom.llm.substring_dedup import op9_substring_dedup
from readloom.llm.token_counts import op3_token_counts
from readloom.llm.topk import OP2_SQL, op2_top_k
from readloom.llm.toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_top_k": op2_top_k,
        "op3_token_counts": op3_token_counts,
        "op4_media_columns": op4_media_columns,
        "op5_simhash": op5_simhash,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_toxicity": op7_toxicity,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_cross_tokens": op11_cross_tokens,
        "op12_source_mix": op12_source_mix,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2_SQL, "op10_line_dedup": OP10_SQL, "op12_source_mix": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
