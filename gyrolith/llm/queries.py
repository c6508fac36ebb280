"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from gyrolith.llm import bpe, exact_dedup, hard_negatives, licenses, line_dedup, media, near_dup, neighbours, packing, pii, toxicity, urls, whitening


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_media": media.op3_media,
        "op4_bpe": bpe.op4_bpe,
        "op5_licenses": licenses.op5_licenses,
        "op6_packing": packing.op6_packing,
        "op7_near_dup": near_dup.op7_near_dup,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_urls": urls.op9_urls,
        "op10_pii": pii.op10_pii,
        "op11_whitening": whitening.op11_whitening,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    }


def oracle_sql():
    return {"op1_line_dedup": line_dedup.SQL, "op5_licenses": licenses.sql(), "op7_near_dup": near_dup.SQL, "op9_urls": urls.sql(), "op10_pii": pii.sql(), "op12_hard_negatives": hard_negatives.SQL, "op13_exact_dedup": exact_dedup.SQL}
