"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, embedding_dedup, html_extract, line_dedup, mixing, packing, passages, quality, repair, simhash, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.query,
    "op2_embedding_near_dedup": embedding_dedup.query,
    "op3_html_extraction": html_extract.query,
    "op4_mixing": mixing.query,
    "op5_decontaminate": decontaminate.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_warc": warc.query,
    "op8_line_dedup": line_dedup.query,
    "op9_substring_dedup": passages.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
    "op11_structure_repair": repair.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_best_fit_packing": packing.query,
}
ORACLE: dict[str, str] = {"op11_structure_repair": repair.ORACLE, "op2_embedding_near_dedup": embedding_dedup.ORACLE, "op9_substring_dedup": passages.ORACLE, "op10_suffix_array_dedup": suffix_dedup.ORACLE, "op4_mixing": mixing.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op7_warc": warc.ORACLE, "op8_line_dedup": line_dedup.ORACLE}
