"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from trajectra.llm import byte_bpe, decontaminate, fim, html_paths, mixing, ogg, pii, quality, runs, similarity_join, substring_seed, substring_suffix, toxicity

QUERIES = {
    "op1_mixing_flow": mixing.op1_mixing_flow,
    "op2_pii_tagger": pii.op2_pii_tagger,
    "op3_media_ogg": ogg.op3_media_ogg,
    "op4_quality_bayes": quality.op4_quality_bayes,
    "op5_similarity_join": similarity_join.op5_similarity_join,
    "op6_substring_suffix": substring_suffix.op6_substring_suffix,
    "op7_html_paths": html_paths.op7_html_paths,
    "op8_toxicity_subword": toxicity.op8_toxicity_subword,
    "op9_decontaminate_simhash": decontaminate.op9_decontaminate_simhash,
    "op10_substring_seed": substring_seed.op10_substring_seed,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

SQL = {
    "op5_similarity_join": similarity_join.SQL,
    "op6_substring_suffix": substring_suffix.SQL,
    "op9_decontaminate_simhash": decontaminate.SQL,
    "op10_substring_seed": substring_seed.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_periodic_runs": runs.SQL,
}
