"""Corpus operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

# imported here, so that where one of them (or what it needs) is missing the whole subpackage is, and nothing else
from . import ann, decontam, jaccard, licenses, line_dedup, lm_score, oracles, packing, repeats, token_counts, toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            decontam.op1_decontamination,
            line_dedup.op2_line_dedup,
            jaccard.op3_ngram_jaccard,
            ann.op4_nearest_neighbours,
            token_counts.op5_token_counts,
            lm_score.op6_lm_scoring,
            packing.op7_packing,
            licenses.op8_license_scan,
            toxicity.op9_toxicity,
            repeats.op10_repeats,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": oracles.OP1_SQL, "op2_line_dedup": line_dedup.OP2_SQL, "op3_ngram_jaccard": oracles.OP3_SQL, "op10_repeats": oracles.OP10_SQL}
