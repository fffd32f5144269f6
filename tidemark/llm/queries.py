"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm import bpe, chat, decontaminate, filteraudit, importance, lines, mixing, prefixhash, secrets, simhash, substrings, topk, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_chat": chat.op4_chat,
    "op5_topk": topk.op5_topk,
    "op6_substrings": substrings.op6_substrings,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_fingerprints": prefixhash.op8_fingerprints,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_importance": importance.op12_importance,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

#: Operators that aren't here can't be expressed in SQL; their tests hold them against brute force.
ORACLES = {
    "op4_chat": chat.OP4_SQL,
    "op5_topk": topk.OP5_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_filter_audit": filteraudit.OP11_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_decontaminate": decontaminate.OP13_SQL,
}
