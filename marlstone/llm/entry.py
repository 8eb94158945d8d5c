"""Queries of the ten operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .lines import op10_lines
from .neardup import op9_neardup
from .packing import op1_packing
from .privacy import op6_privacy
from .quality import op4_quality
from .secrets import op8_secrets
from .topk import OP5_SQL, op5_topk
from .toxicity import op7_toxicity
from .warc import OP3_SQL, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_quality": op4_quality,
        "op5_topk": op5_topk,
        "op6_privacy": op6_privacy,
        "op7_toxicity": op7_toxicity,
        "op8_secrets": op8_secrets,
        "op9_neardup": op9_neardup,
        "op10_lines": op10_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_topk": OP5_SQL}
