"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automaton_dedup, bpe_automaton, chat_format, cotraining, decontaminate, exact_dedup, simhash, suffix_dedup, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": cotraining.op1_quality,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_warc": warc.op3_warc,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_bpe_automaton": bpe_automaton.op5_bpe_automaton,
        "op6_simhash": simhash.op6_simhash,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_automaton_dedup": automaton_dedup.op8_automaton_dedup,
        "op9_token_files": token_files.op9_token_files,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.OP3_SQL, "op7_chat_format": chat_format.OP7_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
