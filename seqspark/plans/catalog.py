"""Registry of named queries.

Each query is a callable ``(spark, sf_dir) -> DataFrame``; most carry an
equivalent DuckDB SQL string (the oracle).  Column names and types are
aligned on both sides (integers BIGINT/INT as noted, floats DOUBLE, rounded
where two engines may differ in the last bits).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE = ["clean_pipeline", "kmer_corr", "strat_kfold", "binary_metrics", "roc_auc",
            "random_infill", "mutation_scan", "trial_summary", "early_stop", "forward_noise",
            "pwm_search", "cv_metrics", "core_identify", "corpus_compare", "generate_compare", "kmer_classifier"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (they register themselves)."""
    from seqspark.plans import (q_clean, q_diffusion, q_encode, q_experiments, q_kmers, q_metrics,  # noqa: F401
                                q_io, q_reverse, q_scoring, q_series, q_split)
