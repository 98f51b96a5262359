"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .chat import op5_chat_formatting
from .ctw import op2_lm_scoring
from .jaccard import op6_ngram_jaccard_join
from .licences import op7_licence_scan
from .oracles import SQL
from .packing import op4_packing
from .quality import op9_quality_rules
from .secret_scan import op1_secret_scan
from .sharding import op8_sharding
from .topk import op10_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_bpe": op3_bpe,
        "op4_packing": op4_packing,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_licence_scan": op7_licence_scan,
        "op8_sharding": op8_sharding,
        "op9_quality_rules": op9_quality_rules,
        "op10_topk": op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
