"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import op1_simhash, op2_decontaminate, op3_mix, op4_media, op5_quality, op6_tokens, op7_lm, op8_chat, op9_shard, op10_license, op11_audit, op12_negatives, op13_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash.query,
        "op2_decontaminate": op2_decontaminate.query,
        "op3_mix": op3_mix.query,
        "op4_media": op4_media.query,
        "op5_quality": op5_quality.query,
        "op6_tokens": op6_tokens.query,
        "op7_lm": op7_lm.query,
        "op8_chat": op8_chat.query,
        "op9_shard": op9_shard.query,
        "op10_license": op10_license.query,
        "op11_filter_audit": op11_audit.query,
        "op12_hard_negatives": op12_negatives.query,
        "op13_url_filter": op13_urls.query,
    }


def oracle_sql() -> dict[str, str]:
    modules = {
        "op2_decontaminate": op2_decontaminate, "op3_mix": op3_mix, "op8_chat": op8_chat, "op11_filter_audit": op11_audit, "op12_hard_negatives": op12_negatives, "op13_url_filter": op13_urls,
    }
    return {name: m.ORACLE_SQL for name, m in modules.items()}
