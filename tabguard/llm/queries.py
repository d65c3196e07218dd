"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from tabguard.llm import alignment, brown, decontam, infill, mixing, neardup, neighbours, pages, pii, quality, secrets, substrings, toxicity

QUERIES = {
    "op1_extract": pages.op1_extract,
    "op2_secrets": secrets.op2_secrets,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substrings": substrings.op5_substrings,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_nearest": neighbours.op7_nearest,
    "op8_language_model": brown.op8_language_model,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_personal_data": pii.op11_personal_data,
    "op12_alignment": alignment.op12_alignment,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op6_decontamination": decontam.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op13_fill_in_middle": infill.ORACLE_SQL,
}
