"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from meadow.llm import chat, lines, mixing, neardup, negatives, packing, pii, quality, search, spelling, substrings, tokens, vectors

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_vectors": vectors.op2_vectors,
    "op3_lines": lines.op3_lines,
    "op4_tokens": tokens.op4_tokens,
    "op5_search": search.op5_search,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_chat": chat.op9_chat,
    "op10_pii": pii.op10_pii,
    "op11_substrings": substrings.op11_substrings,
    "op12_spelling": spelling.op12_spelling,
    "op13_negatives": negatives.op13_negatives,
}
ORACLE = {
    "op1_neardup": neardup.OP1_SQL,
    "op2_vectors": vectors.OP2_SQL,
    "op3_lines": lines.OP3_SQL,
    "op5_search": search.OP5_SQL,
    "op9_chat": chat.OP9_SQL,
    "op11_substrings": substrings.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_negatives": negatives.OP13_SQL,
}
