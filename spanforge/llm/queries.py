"""The queries of this subpackage and, where SQL can express one, the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .chat import op8_chat_format
from .quality_rules import op9_quality_rules
from .simhash import op3_simhash
from .decontaminate import op5_decontaminate
from .repair import op4_repair_tokens
from .packing import op6_packing
from .unit_dedup import op2_unit_dedup
from .toxicity import op7_toxicity
from .byte_cnn import op10_byte_cnn
from .license_scan import op1_license_scan
from .suffix_dedup import op11_suffix_dedup
from .whitening import op12_whitening
from .vector_codes import op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_simhash": op3_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op5_decontaminate": op5_decontaminate,
    "op4_repair_tokens": op4_repair_tokens,
    "op6_packing": op6_packing,
    "op2_unit_dedup": op2_unit_dedup,
    "op7_toxicity": op7_toxicity,
    "op10_byte_cnn": op10_byte_cnn,
    "op1_license_scan": op1_license_scan,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op8_chat_format": oracles.OP8,
    "op9_quality_rules": oracles.OP9,
    "op5_decontaminate": oracles.OP5,
    "op2_unit_dedup": oracles.OP2,
    "op11_suffix_dedup": oracles.OP11,
    "op13_vector_codes": oracles.OP13,
}
