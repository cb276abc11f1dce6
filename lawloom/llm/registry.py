"""The queries of this folder and their SQL; the pipeline registers itself in corpus_pipeline."""

from __future__ import annotations

from . import bpe, decontaminate, fim, html_text, language, minhash, mpeg, passages, periodic, pii, quality, repeats, url_rules

QUERIES = {
    "op1_mpeg_audio": mpeg.op1_mpeg,
    "op2_spaced_seed_decontamination": decontaminate.op2_decontaminate,
    "op3_suffix_array_dedup": repeats.op3_repeats,
    "op4_discriminant_quality": quality.op4_quality,
    "op5_ftrl_language": language.op5_language,
    "op6_url_rules": url_rules.op6_url_rules,
    "op7_transducer_bpe": bpe.op7_bpe,
    "op8_tag_path_text": html_text.op8_html_text,
    "op9_fixed_block_dedup": passages.op9_passages,
    "op10_hyperminhash_dedup": minhash.op10_near_duplicates,
    "op11_disclosure_pii": pii.op11_disclosure,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL = {"op6_url_rules": url_rules.ORACLE, "op12_fill_in_middle": fim.ORACLE}
