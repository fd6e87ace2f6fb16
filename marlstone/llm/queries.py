"""The queries of this subpackage, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import ann, htmltext, mixing, packing, rules, secrets, simhash, suffix_dedup, toolcalls, warc
from marlstone.llm.common import table


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_bundles": lambda spark, d: warc.op1_warc(table(spark, d, "pages")),
        "op2_tool_call_linking": lambda spark, d: toolcalls.op2_tool_calls(table(spark, d, "conversations")),
        "op3_pareto_mixing": lambda spark, d: mixing.op3_pareto_mixing(table(spark, d, "documents")),
        "op4_quality_rules": lambda spark, d: rules.op4_quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_secret_scan": lambda spark, d: secrets.op5_secret_scan(table(spark, d, "documents")),
        "op6_suffix_dedup": lambda spark, d: suffix_dedup.op6_suffix_dedup(table(spark, d, "documents")),
        "op7_html_text": lambda spark, d: htmltext.op7_html_text(table(spark, d, "pages")),
        "op8_simhash_near_duplicates": lambda spark, d: simhash.op8_simhash(table(spark, d, "documents")),
        "op9_vector_bin_packing": lambda spark, d: packing.op9_packing(table(spark, d, "documents")),
        "op10_ann_search": lambda spark, d: ann.op10_ann_search(table(spark, d, "embeddings")),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": warc.OP1_SQL, "op2_tool_call_linking": toolcalls.OP2_SQL}
