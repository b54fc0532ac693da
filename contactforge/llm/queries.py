"""The queries of this subpackage and the SQL that the driver compares them with."""
from __future__ import annotations

from . import bpe, langid, licenses, lm, media, mixing, neardup, pagetext, quality, resample, topk, urlrules, whitening

QUERIES = {
    "op1_media": media.op1_media,
    "op2_quality": quality.op2_quality,
    "op3_pagetext": pagetext.op3_pagetext,
    "op4_language": langid.op4_language,
    "op5_bpe": bpe.op5_bpe,
    "op6_simhash": neardup.op6_simhash,
    "op7_topk": topk.op7_topk,
    "op8_licenses": licenses.op8_licenses,
    "op9_mixing": mixing.op9_mixing,
    "op10_urls": urlrules.op10_urls,
    "op11_whitening": whitening.op11_whitening,
    "op12_lm": lm.op12_lm,
    "op13_resample": resample.op13_resample,
}
ORACLE_SQL: dict[str, str] = {"op7_topk": topk.OP7_SQL, "op9_mixing": mixing.OP9_SQL, "op13_resample": resample.OP13_SQL}
