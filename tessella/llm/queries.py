"""The queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import erasure, fingerprint, infill, jaccard_join, lattice, line_dedup, mixing, packing, quality, search, toxicity, warc, wavelet
from tessella.llm.shared import ship


def _shipped(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": _shipped(fingerprint.op1_fingerprint),
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_best_fit_packing": _shipped(packing.op3_best_fit_packing),
        "op4_wavelet_tokens": _shipped(wavelet.op4_wavelet_tokens),
        "op5_toxicity": _shipped(toxicity.op5_toxicity),
        "op6_warc": _shipped(warc.op6_warc),
        "op7_jaccard_join": _shipped(jaccard_join.op7_jaccard_join),
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_quality": _shipped(quality.op9_quality),
        "op10_bm25_top_k": _shipped(search.op10_bm25_top_k),
        "op11_erasure": _shipped(erasure.op11_erasure),
        "op12_infill": _shipped(infill.op12_infill),
        "op13_lattice_score": _shipped(lattice.op13_lattice_score),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.OP2_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_jaccard_join": jaccard_join.OP7_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op10_bm25_top_k": search.OP10_SQL,
    }
