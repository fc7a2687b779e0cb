"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import hard_negatives, language_id, line_dedup, mixing, near_dedup, online_packing, packing, phrases, pii, quality_mil, quality_rules, substrings, topk

MODULES = (quality_rules, mixing, quality_mil, packing, near_dedup, substrings, pii, line_dedup, language_id, topk, online_packing, phrases, hard_negatives)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in MODULES for k, f in m.ORACLES.items()}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
