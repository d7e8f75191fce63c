"""Queries of the operators: names, functions and, where SQL can express one, DuckDB SQL."""

from __future__ import annotations

from . import ann, decontaminate, lm_score, near_dups, oracles, packing, pii, quality, repeats, secrets, token_counts

QUERIES = {
    "op1_packing": packing.query,
    "op2_token_counts": token_counts.query,
    "op3_quality": quality.query,
    "op4_repeats": repeats.query,
    "op5_secrets": secrets.query,
    "op6_pii": pii.query,
    "op7_decontamination": decontaminate.query,
    "op8_nearest": ann.query,
    "op9_lm_score": lm_score.query,
    "op10_near_dups": near_dups.query,
}
ORACLES: dict[str, str] = {"op4_repeats": oracles.REPEATS, "op7_decontamination": oracles.DECONTAMINATION, "op10_near_dups": oracles.NEAR_DUPS}
