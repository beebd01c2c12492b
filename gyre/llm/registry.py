"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .ann import op11_ann
from .licenses import OP7_SQL, op7_license_scan
from .lm import op3_lm_score
from .media import op10_media_columns
from .mixing import OP5_SQL, op5_mixing
from .near_dedup import op4_near_dedup
from .packing import op9_packing
from .quality import op2_quality
from .spelling import op13_spelling
from .suffix_dedup import op1_suffix_dedup
from .token_files import op6_token_files
from .topk import OP8_SQL, op8_topk
from .whitening import op12_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_quality, op3_lm_score, op4_near_dedup, op5_mixing, op6_token_files, op7_license_scan, op8_topk, op9_packing, op10_media_columns, op11_ann, op12_whitening, op13_spelling)
}
ORACLE_SQL: dict[str, str] = {"op5_mixing": OP5_SQL, "op7_license_scan": OP7_SQL, "op8_topk": OP8_SQL}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
