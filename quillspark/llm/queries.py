"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11_collocations
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontamination import op10_decontamination
from .line_dedup import op4_line_dedup
from .packing import op5_best_fit_packing
from .pii import op9_pii
from .quality_classifier import op3_quality_classifier
from .quality_rules import op8_quality_rules
from .simhash import op1_simhash
from .suffix_dedup import op6_suffix_dedup
from .tiered_packing import op12_tiered_packing
from .url_filters import op7_url_filters
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_warc": op2_warc, "op4_line_dedup": op4_line_dedup, "op10_decontamination": op10_decontamination, "op6_suffix_dedup": op6_suffix_dedup, "op7_url_filters": op7_url_filters, "op3_quality_classifier": op3_quality_classifier, "op5_best_fit_packing": op5_best_fit_packing, "op8_quality_rules": op8_quality_rules, "op9_pii": op9_pii, "op11_collocations": op11_collocations, "op12_tiered_packing": op12_tiered_packing, "op13_conversation_repair": op13_conversation_repair}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op11_collocations": OP11_SQL, "op13_conversation_repair": OP13_SQL}
