"""Queries of the llm subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfwise.llm import bpe, decontaminate, jaccard, licenses, media, oracles, packing, quality, repair, secrets, sharding, toxicity, whitening, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ledger": secrets.op1_secret_ledger,
    "op2_wav_fingerprints": media.op2_wav_fingerprints,
    "op3_adaptive_prefix_join": jaccard.op3_adaptive_prefix_join,
    "op4_feistel_shards": sharding.op4_feistel_shards,
    "op5_superkmer_dedup": windows.op5_superkmer_dedup,
    "op6_ordinal_toxicity": toxicity.op6_ordinal_toxicity,
    "op7_template_decontamination": decontaminate.op7_template_decontamination,
    "op8_license_bands": licenses.op8_license_bands,
    "op9_subword_quality": quality.op9_subword_quality,
    "pipeline": corpus_pipeline.run,
    "op10_chunked_bpe": bpe.op10_chunked_bpe,
    "op11_turn_fold": repair.op11_turn_fold,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_jacobi_whitening": whitening.op13_jacobi_whitening,
}

ORACLES: dict[str, str] = {"op1_secret_ledger": secrets.OP1_SQL, "op3_adaptive_prefix_join": oracles.OP3_SQL, "op5_superkmer_dedup": oracles.OP5_SQL, "op11_turn_fold": repair.OP11_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
