"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, chat, exact_dedup, html_text, licences, mixing, quality, runs, simhash, substring_dedup, token_files, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substrings": substring_dedup.op3_substrings,
    "op4_token_files": token_files.op4_token_files,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_licences": licences.op7_licences,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
    "op11_html": html_text.op11_html,
    "op12_runs": runs.op12_runs,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_quality": quality.OP6_SQL,
    "op7_licences": licences.OP7_SQL,
}
