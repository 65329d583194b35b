"""Queries of the operators in this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, byte_bpe, merkle, mixing, ngram_join, packing, quality_rules, sharding, spotsigs, tool_calls, toxicity, url_filter, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_spotsigs": spotsigs.op3_spotsigs,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_sharding": sharding.op6_sharding,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
    "op11_merkle": merkle.op11_merkle,
    "op12_mixing": mixing.op12_mixing,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES: dict[str, str] = {
    "op4_tool_calls": tool_calls.OP4_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_mixing": mixing.OP12_SQL,
}
