"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from panelspark.llm import decontaminate, fim, knn, lines, maxent, packing, periodic, quality, setjoin, simhash, substrings, suffixes, toxicity

QUERIES = {
    "op1_nearest_neighbours": knn.op1_nearest_neighbours,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_jaccard_join": setjoin.op8_ngram_jaccard_join,
    "op9_lm_scoring": maxent.op9_lm_scoring,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_simhash_near_dedup": simhash.op11_simhash_near_dedup,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op1_nearest_neighbours": knn.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op5_suffix_array_dedup": suffixes.ORACLE,
    "op8_ngram_jaccard_join": setjoin.ORACLE,
    "op12_periodic_runs": periodic.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
