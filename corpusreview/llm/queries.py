"""The named queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusreview.llm import bpe, fingerprints, html_text, licenses, lines, lm, manifest, mixing, ngram_join, quality, rules, spelling, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": lm.op1_lm_scores,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_html_text": html_text.op3_html_text,
    "op4_licenses": licenses.op4_licenses,
    "op5_topk": topk.op5_topk,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_spelling_groups": spelling.op11_spelling_groups,
    "op12_quality_rules": rules.op12_quality_rules,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_topk": topk.OP5_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_spelling_groups": spelling.OP11_SQL,
    "op12_quality_rules": rules.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
