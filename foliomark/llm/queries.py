"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomark.llm import collocations, decontaminate, jaccard_join, language_id, nn_descent, packing, pii, prefix_trie, quality, site_tree, substring, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_nn_descent": nn_descent.op3_nn_descent,
    "op4_pii": pii.op4_pii,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_site_style_tree": site_tree.op11_site_style_tree,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE: dict[str, str] = {
    "op3_nn_descent": nn_descent.op3_sql(),
    "op5_substring_dedup": substring.op5_sql(),
    "op6_url_filter": url_filter.op6_sql(),
    "op9_jaccard_join": jaccard_join.op9_sql(),
    "op10_decontamination": decontaminate.op10_sql(),
    "op11_site_style_tree": site_tree.op11_sql(),
    "op12_prefix_trie": prefix_trie.op12_sql(),
    "op13_collocations": collocations.op13_sql(),
}
