"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .fast_sketch import OP3_SQL, op3_fast_sketch
from .flat_graph import op8_flat_graph
from .kn_quality import op5_kn_quality
from .leaks import OP9_SQL, op9_leaks
from .merkle import OP11_SQL, op11_merkle
from .piece_bpe import op10_piece_bpe
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .suffix_dedup import op6_suffix_dedup
from .token_files import op7_token_files
from .tool_calls import OP2_SQL, op2_tool_calls
from .toxicity import op1_toxicity
from .url_rules import OP4_SQL, op4_url_rules
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_tool_calls": op2_tool_calls,
    "op3_fast_sketch": op3_fast_sketch,
    "op4_url_rules": op4_url_rules,
    "op5_kn_quality": op5_kn_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_files": op7_token_files,
    "op8_flat_graph": op8_flat_graph,
    "op9_leaks": op9_leaks,
    "op10_piece_bpe": op10_piece_bpe,
    "op11_merkle": op11_merkle,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op2_tool_calls": OP2_SQL,
    "op3_fast_sketch": OP3_SQL,
    "op4_url_rules": OP4_SQL,
    "op9_leaks": OP9_SQL,
    "op11_merkle": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
