"""The queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from . import decontaminate, exact_dedup, langid, licenses, lm, mixing, quality, simhash, tokencount, toxicity

QUERIES = {
    "op1_langid": langid.query,
    "op2_lm_score": lm.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": tokencount.query,
    "op6_licenses": licenses.query,
    "op7_quality": quality.query,
    "op8_simhash": simhash.query,
    "op9_mixing": mixing.query,
    "op10_decontaminate": decontaminate.query,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_licenses": licenses.ORACLE,
}
