"""The operators' queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, exact, maxent, mixing, near, quality, recompress, secrets, suffixes, tokenfile

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": recompress.op3_substring_dedup,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_near_dedup": near.op5_near_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_lm_scoring": maxent.op8_lm_scoring,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}
SQL = {"op1_quality_rules": quality.OP1_SQL, "op3_substring_dedup": recompress.OP3_SQL, "op4_exact_dedup": exact.OP4_SQL, "op5_near_dedup": near.OP5_SQL, "op10_suffix_dedup": suffixes.OP10_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
