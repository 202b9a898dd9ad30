"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import sql
from .chat import op6_chat_format
from .decontaminate import op7_decontamination
from .licenses import op4_license_scan
from .minhash import op3_minhash_dedup
from .packing import op9_packing
from .pii import op8_pii
from .quality import op1_quality_rules
from .sharding import op2_sharding
from .tokens import op10_token_counts
from .toxicity import op5_toxicity

_OPS = [op1_quality_rules, op2_sharding, op3_minhash_dedup, op4_license_scan, op5_toxicity, op6_chat_format, op7_decontamination, op8_pii, op9_packing, op10_token_counts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """op3 alone: what the others decide comes from learned rules, samples, tokenizers, keyed permutations or fuzzy matching, and is tested by brute force."""
    return {"op3_minhash_dedup": sql.OP3}
