"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyloom.llm import alignment, cross_parsing, dual_tree, exact_dedup, hnsw, html_text, jaccard_join, packing, pieces, quality, toxicity, url_filter, wavelet

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op10_quality": quality.op10_quality,
    "op11_alignment": alignment.op11_alignment,
    "op12_cross_parsing": cross_parsing.op12_cross_parsing,
    "op13_dual_tree": dual_tree.op13_dual_tree,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_hnsw_shards": hnsw.op7_hnsw_shards,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_wavelet_files": wavelet.op9_wavelet_files,
}
ORACLE_SQL = {"op13_dual_tree": dual_tree.SQL, "op3_exact_dedup": exact_dedup.SQL}
