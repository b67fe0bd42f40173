"""Registered queries of the operators, one ``opN_<name>`` each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.common import ship_package
from panelspark.llm import divergence as _divergence, hard_negatives as _hard_negatives, secrets as _secrets
from panelspark.llm.ann import op6_nearest
from panelspark.llm.divergence import op11_divergence
from panelspark.llm.fingerprints import op8_fingerprints
from panelspark.llm.hard_negatives import op13_hard_negatives
from panelspark.llm.mixing import op7_source_mix
from panelspark.llm.near_dup import op1_near_duplicates
from panelspark.llm.packing import op4_packing
from panelspark.llm.quality import op9_quality
from panelspark.llm.secrets import op12_secrets
from panelspark.llm.sharding import op10_balanced_shards
from panelspark.llm.substring_dedup import op5_substring_dedup
from panelspark.llm.token_counts import op2_token_counts
from panelspark.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {f.__name__: _shipped(f) for f in (op1_near_duplicates, op2_token_counts, op3_toxicity, op4_packing, op5_substring_dedup, op6_nearest, op7_source_mix, op8_fingerprints, op9_quality, op10_balanced_shards, op11_divergence, op12_secrets, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op11_divergence": _divergence.ORACLE, "op12_secrets": _secrets.ORACLE, "op13_hard_negatives": _hard_negatives.ORACLE}
