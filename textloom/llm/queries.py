"""Queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from . import chat_format, decontaminate, hard_negatives, importance, language_id, mixing, near_dup, pii, quality_model, quality_rules, repeats, simhash, url_filter


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_decontaminate": decontaminate.query,
        "op3_pii": pii.query,
        "op4_mixing": mixing.query,
        "op5_url_filter": url_filter.query,
        "op6_chat_format": chat_format.query,
        "op7_near_dup": near_dup.query,
        "op8_repeats": repeats.query,
        "op9_quality_rules": quality_rules.query,
        "op10_quality_model": quality_model.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_simhash": simhash.query,
        "op13_importance_resampling": importance.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.SQL,
        "op4_mixing": mixing.sql(),
        "op6_chat_format": chat_format.SQL,
        "op7_near_dup": near_dup.sql(),
        "op9_quality_rules": quality_rules.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op13_importance_resampling": importance.SQL,
    }
