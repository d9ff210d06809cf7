"""Registry of the training-data queries: one ``opN_<name>`` per operator, plus ``pipeline``."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_range_coder": "op01_tokens",
    "op2_parity_sketch_join": "op02_jaccard",
    "op3_nn_descent": "op03_nndescent",
    "op4_minimum_bin_slack": "op04_pack",
    "op5_license_scan": "op05_license",
    "op6_lpt_shards": "op06_shard",
    "op7_winnowing": "op07_winnow",
    "op8_cross_parsing": "op08_langid",
    "op9_ppm": "op09_ppm",
    "op10_path_ratio": "op10_html",
    "op11_splitting_tree": "op11_mix",
    "op12_scalar_dag": "op12_repair",
    "op13_pattern_tree": "op13_audit",
}


def queries() -> dict:
    return {name: getattr(import_module(f"seqspark.llm.{mod}"), name) for name, mod in _MODULES.items()}


def oracle_sql() -> dict:
    from seqspark.llm.op02_jaccard import OP2_SQL
    from seqspark.llm.op07_winnow import OP7_SQL
    from seqspark.llm.op11_mix import OP11_SQL
    from seqspark.llm.op12_repair import OP12_SQL
    from seqspark.llm.op13_audit import OP13_SQL
    return {"op2_parity_sketch_join": OP2_SQL, "op7_winnowing": OP7_SQL, "op11_splitting_tree": OP11_SQL,
            "op12_scalar_dag": OP12_SQL, "op13_pattern_tree": OP13_SQL}
