"""Queries of this subpackage and the same in SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, collocations, covertree, language, lines, mixing, neighbours, pii, secrets, simhash, toolcalls, trie, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_pareto_mix": mixing.op1,
        "op2_simhash_golay": simhash.op2,
        "op3_cover_tree_links": covertree.op3,
        "op4_multipart_secrets": secrets.op4,
        "op5_weak_supervision_pii": pii.op5,
        "op6_tool_call_links": toolcalls.op6,
        "op7_forced_boundary_bpe": bpe.op7,
        "op8_posting_list_ann": neighbours.op8,
        "op9_edit_join_lines": lines.op9,
        "op10_crf_language": language.op10,
        "op11_warc_zstd": warc.op11,
        "op12_sorted_collocations": collocations.op12,
        "op13_prefix_trie": trie.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": mixing.OP1_SQL,
        "op3_cover_tree_links": covertree.OP3_SQL,
        "op6_tool_call_links": toolcalls.OP6_SQL,
        "op11_warc_zstd": warc.OP11_SQL,
        "op12_sorted_collocations": collocations.OP12_SQL,
        "op13_prefix_trie": trie.OP13_SQL,
    }
