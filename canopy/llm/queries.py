"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, host_rules, html_blocks, language, line_frequency, minhash, pieces, quality, sharding

QUERIES = {
    "op1_dart_minhash": minhash.query,
    "op2_suffix_array_pieces": pieces.query,
    "op3_chat_windows": chat.query,
    "op4_line_frequency": line_frequency.query,
    "op5_block_tree": html_blocks.query,
    "op6_boosted_quality": quality.query,
    "op7_positional_decontamination": decontaminate.query,
    "op8_bloom_language": language.query,
    "op9_host_rules": host_rules.query,
    "op10_histogram_shards": sharding.query,
}
ORACLES = {
    "op4_line_frequency": line_frequency.SQL,
    "op7_positional_decontamination": decontaminate.SQL,
    "op9_host_rules": host_rules.SQL,
}
