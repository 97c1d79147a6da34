"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import OP2_SQL, op2_decontaminate
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_text import op9_html_text
from .jaccard_join import OP7_SQL, op7_ngram_jaccard
from .line_dedup import op4_line_dedup
from .lm_scoring import op1_deleted_interpolation
from .pii import op6_pii
from .quality import op5_quality
from .sentencepiece_nbest import op3_sentencepiece_nbest

QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_decontaminate": op2_decontaminate,
    "op3_sentencepiece_nbest": op3_sentencepiece_nbest,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_text": op9_html_text,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_chat_format": OP10_SQL}
