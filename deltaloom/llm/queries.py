"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import ann, bpe, decontaminate, divergence, fim, html, lm, packing, sharding, simhash, suffixes, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_html_extraction": html.op3_html_extraction,
        "op4_suffix_array_dedup": suffixes.op4_suffix_array_dedup,
        "op5_lm_scoring": lm.op5_lm_scoring,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_warc": warc.op7_warc,
        "op8_ann_search": ann.op8_ann_search,
        "op9_token_packing": packing.op9_token_packing,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_fim": fim.op11_fim,
        "op12_sharding": sharding.op12_sharding,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.ORACLE, "op11_fim": fim.ORACLE, "op13_divergence": divergence.ORACLE}
