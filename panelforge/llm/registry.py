"""Queries over the text tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import ann, bpe, decontam, divergence, jaccard, langid, lexical, packing, pii, quality, substring_dedup, toxicity, url_reputation

_MODULES = (pii, decontam, jaccard, toxicity, quality, url_reputation, packing, langid, ann, substring_dedup, bpe, lexical, divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.ORACLES
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
