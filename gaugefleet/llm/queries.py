"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .decontaminate import op6_decontaminate
from .licences import op8_licences
from .line_dedup import op2_line_dedup
from .neardup import op9_near_duplicates
from .ngram_quality import op3_quality_rules
from .oracles import ORACLES
from .pack import op1_pack
from .periodic_runs import op11_periodic_runs
from .pu_quality import op7_quality
from .sanitise import op5_personal_data
from .site_tree import op4_extract
from .source_audit import op12_source_audit
from .url_filter import op13_url_filter
from .warc import op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_extract": op4_extract,
        "op5_personal_data": op5_personal_data,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_licences": op8_licences,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_warc": op10_warc,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_source_audit": op12_source_audit,
        "op13_url_filter": op13_url_filter,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": sql} if (sql := corpus_pipeline.ORACLE_SQL) else {})
