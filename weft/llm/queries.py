"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name to module; each module has query(spark, sf_dir) and, where SQL can say it, SQL.
MODULES = {
    "op1_jaccard_join": "jaccard_rtree",
    "op2_warc_archive": "warc_store",
    "op3_nearest_vectors": "cross_polytope",
    "op4_mix_sources": "pareto_mix",
    "op5_pack_sequences": "slack_packing",
    "op6_token_shards": "repair_store",
    "op7_toxicity": "nearest_toxic",
    "op8_exact_dedup": "block_naming",
    "op9_main_text": "html_blocks",
    "op10_class_lm": "brown_lm",
    "op11_source_divergence": "source_divergence",
    "op12_run_detection": "repetition_runs",
    "op13_substring_dedup": "recompression",
}


def query(name: str):
    return importlib.import_module(f"weft.llm.{MODULES[name]}").query


def sql(name: str) -> str | None:
    return getattr(importlib.import_module(f"weft.llm.{MODULES[name]}"), "SQL", None)
