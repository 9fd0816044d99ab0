"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP3_SQL, op3_decontamination
from .html_text import op10_html_text
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .mixing import op7_mixing, op7_sql
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_pu import op8_quality_pu
from .quality_rules import op4_quality_rules
from .sharding import OP12_SQL, op12_sharding
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .token_counts import op5_token_counts
from .token_files import op2_token_ids
from .tool_calls import op1_tool_calls
from .turn_repair import op13_sql, op13_turn_repair


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tool_calls": op1_tool_calls,
        "op2_token_ids": op2_token_ids,
        "op3_decontamination": op3_decontamination,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_counts": op5_token_counts,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_mixing": op7_mixing,
        "op8_quality_pu": op8_quality_pu,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_html_text": op10_html_text,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_sharding": op12_sharding,
        "op13_turn_repair": op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op7_mixing": op7_sql(),
        "op9_substring_dedup": OP9_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_sharding": OP12_SQL,
        "op13_turn_repair": op13_sql(),
    }
