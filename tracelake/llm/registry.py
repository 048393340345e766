"""Queries of this subpackage, and the SQL that their results are held against."""

from . import backoff_lm, decontaminate, hard_negatives, language_id, license_scan, line_dedup, main_text, merge_dropout, ngram_join, periodic_runs, permutation_index, repeats, token_files

QUERIES = {
    "op1_permutation_index": permutation_index.op1_permutation_index,
    "op2_token_counts": token_files.op2_token_counts,
    "op3_language_id": language_id.op3_language_id,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_repeats": repeats.op5_repeats,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_merge_dropout": merge_dropout.op7_merge_dropout,
    "op8_backoff_lm": backoff_lm.op8_backoff_lm,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_main_text": main_text.op12_main_text,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_backoff_lm": backoff_lm.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
