"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language_model, mixing, near_duplicates, pii, quality, tiff, token_counts, toxicity, warc

QUERIES = {
    "op1_tiff_media": tiff.op1_tiff_media,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_model": language_model.op4_language_model,
    "op5_pii": pii.op5_pii,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL = {"op3_mixing": mixing.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op9_near_duplicates": near_duplicates.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL}
