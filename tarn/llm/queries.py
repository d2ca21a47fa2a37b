"""Queries of the pipeline operators, one for each, over whole tables."""

from __future__ import annotations

from . import brown, cws, decontam, html, langid, mixing, repeats, secrets, simhash, tokens

QUERIES = {
    "op3_suffix_dedup": repeats.query,
    "op1_decontamination": decontam.query,
    "op4_brown_lm": brown.query,
    "op2_html_extraction": html.query,
    "op9_source_mix": mixing.query,
    "op6_token_counts": tokens.query,
    "op5_secret_scan": secrets.query,
    "op7_language_id": langid.query,
    "op10_weighted_fingerprints": cws.query,
    "op8_simhash_near_dedup": simhash.query,
}

#: Queries that SQL can state.
ORACLES: dict[str, str] = {"op9_source_mix": mixing.ORACLE}
