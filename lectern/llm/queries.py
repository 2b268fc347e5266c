"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op9_balanced_lists
from .byte_bpe import op10_byte_bpe
from .chat import OP3_SQL, op3_chat_parts
from .line_dedup import OP7_SQL, op7_site_line_dedup
from .packing import op4_differencing_packing
from .pii import op2_pii_deobfuscation
from .quality import op6_weak_quality
from .simhash import op8_simhash_anchors
from .toxicity import op5_subword_toxicity
from .warc import OP1_SQL, op1_warc_seekable

QUERIES = {
    f.__name__: f
    for f in (op1_warc_seekable, op2_pii_deobfuscation, op3_chat_parts, op4_differencing_packing, op5_subword_toxicity, op6_weak_quality, op7_site_line_dedup, op8_simhash_anchors, op9_balanced_lists, op10_byte_bpe)
}
ORACLE_SQL = {"op1_warc_seekable": OP1_SQL, "op3_chat_parts": OP3_SQL, "op7_site_line_dedup": OP7_SQL}
