"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .bpe import op5_bpe
from .byteconv import op3_quality_score
from .chat import OP8_SQL, op8_chat_format
from .idstore import op2_token_store
from .jaccard import op7_jaccard_join
from .linerules import OP4_SQL, op4_line_rules
from .packing import op10_pack
from .secretscan import op6_secret_scan
from .suffix import op9_suffix_dedup
from .vptree import op1_vptree_search

QUERIES = {
    "op1_vptree_search": op1_vptree_search,
    "op2_token_store": op2_token_store,
    "op3_quality_score": op3_quality_score,
    "op4_line_rules": op4_line_rules,
    "op5_bpe": op5_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_chat_format": op8_chat_format,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pack": op10_pack,
}

ORACLE_SQL = {
    "op4_line_rules": OP4_SQL,
    "op8_chat_format": OP8_SQL,
}
