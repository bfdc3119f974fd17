"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from ledgerloom.llm import ann, filter_audit, fim, kneser_ney, licenses, mixing, near_dedup, packing, quality_rules, secrets, toxicity, vector_dedup, warc


def queries() -> dict:
    return {
        "op1_kneser_ney_quality": kneser_ney.op1_kneser_ney_quality,
        "op2_lexicon_toxicity": toxicity.op2_lexicon_toxicity,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_blob_ledger_secrets": secrets.op4_blob_ledger_secrets,
        "op5_hash_prefix_forest": ann.op5_hash_prefix_forest,
        "op6_soft_membership_mixing": mixing.op6_soft_membership_mixing,
        "op7_winnowed_licenses": licenses.op7_winnowed_licenses,
        "op8_weak_supervision_rules": quality_rules.op8_weak_supervision_rules,
        "op9_setsketch_near_dedup": near_dedup.op9_setsketch_near_dedup,
        "op10_warc_chunks": warc.op10_warc_chunks,
        "op11_lookaround_fim": fim.op11_lookaround_fim,
        "op12_hyperplane_dedup": vector_dedup.op12_hyperplane_dedup,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_blob_ledger_secrets": secrets.SQL_OP4,
        "op9_setsketch_near_dedup": near_dedup.SQL_OP9,
        "op10_warc_chunks": warc.SQL_OP10,
        "op11_lookaround_fim": fim.SQL_OP11,
        "op13_filter_audit": filter_audit.SQL_OP13,
    }
