"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .extract import op8_html_extraction
from .langid import op3_language_id
from .licenses import OP9_SQL, op9_license_scan
from .mixing import OP6_SQL, op6_source_mixing
from .neighbours import op4_nearest_neighbours
from .packing import op2_best_fit_packing
from .quality import ABLATIONS_SQL, OP7_SQL, op7_quality_rules, quality_ablations
from .simhash import op1_simhash_near_dedup
from .suffixes import op10_suffix_array_dedup
from .urlfilter import OP5_SQL, op5_url_filter

_QUERIES = (op1_simhash_near_dedup, op2_best_fit_packing, op3_language_id, op4_nearest_neighbours, op6_source_mixing, op7_quality_rules, op5_url_filter, op8_html_extraction, op9_license_scan, op10_suffix_array_dedup, quality_ablations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {op6_source_mixing.__name__: OP6_SQL, op7_quality_rules.__name__: OP7_SQL, op5_url_filter.__name__: OP5_SQL, op9_license_scan.__name__: OP9_SQL, quality_ablations.__name__: ABLATIONS_SQL}
