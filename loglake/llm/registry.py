"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from loglake.llm import url_filter
from loglake.llm.decontaminate import op2_decontamination
from loglake.llm.fingerprints import op4_fingerprints
from loglake.llm.line_dedup import op3_line_dedup
from loglake.llm.near_dedup import op7_near_dedup
from loglake.llm.packing import op1_packing
from loglake.llm.quality import op6_quality
from loglake.llm.secrets import op5_secrets
from loglake.llm.sentence_spans import op9_sentence_spans
from loglake.llm.token_counts import op8_token_counts

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES = {"op10_url_filter": url_filter.ORACLE}
