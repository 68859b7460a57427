"""Registered queries of the corpus operators: name to (spark, sf_dir) function, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, chat, decontaminate, divergence, fingerprints, html_text, licences, near_dup, quality, runs, secrets, shards, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": html_text.op1_main_text,
    "op2_preference_pairs": chat.op2_preference_pairs,
    "op3_benchmark_leaks": decontaminate.op3_benchmark_leaks,
    "op5_near_duplicates": near_dup.op5_near_duplicates,
    "op6_licence_scan": licences.op6_licence_scan,
    "op7_quality_scores": quality.op7_quality_scores,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_balanced_shards": shards.op10_balanced_shards,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_capture_index": warc.op13_capture_index,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_preference_pairs": chat.OP2_SQL,
    "op6_licence_scan": licences.OP6_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_capture_index": warc.OP13_SQL,
}
