"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from codestrata.llm import decontaminate, exact_search, language_model, merkle, mixing, near_dedup, quality, secret_scan, sharding, substring_dedup, token_store, vector_codes, vector_search
from codestrata.llm.common import ship


def _shipping(f):
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries():
    own = [mixing.op1_mixing, language_model.op2_language_model, quality.op3_quality, token_store.op4_token_store, substring_dedup.op5_substring_dedup, sharding.op6_sharding, secret_scan.op7_secrets, vector_search.op8_vector_search, near_dedup.op9_near_dedup, decontaminate.op10_decontaminate, merkle.op11_merkle_manifest, vector_codes.op12_vector_codes, exact_search.op13_exact_search]
    return {f.__name__: _shipping(f) for f in own}


def oracle_sql():
    return mixing.ORACLE | merkle.ORACLE | vector_codes.ORACLE | exact_search.ORACLE
