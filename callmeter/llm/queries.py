"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import decontaminate, divergence, licenses, media, mixing, near_dedup, periodic, pii, quality, token_index, toxicity, url_lists, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_warc": warc.op2_warc,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_licenses": licenses.op4_licenses,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_url_lists": url_lists.op10_url_lists,
    "op11_divergence": divergence.op11_divergence,
    "op12_token_index": token_index.op12_token_index,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {
    "op10_url_lists": url_lists.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
}
