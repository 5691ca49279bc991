"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tidewheel.llm import decontaminate, fuzzy_lines, hard_negatives, mixing, near_dups, phrases, quality, secrets, sharding, suffix_dedup, topk, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_secrets": secrets.op2_secrets,
    "op3_shard": sharding.op3_shard,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_fuzzy_lines": fuzzy_lines.op5_fuzzy_lines,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality": quality.op7_quality,
    "op8_urls": urls.op8_urls,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_mix": mixing.op10_mix,
    "op11_topk": topk.op11_topk,
    "op12_phrases": phrases.op12_phrases,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op3_shard": sharding.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op8_urls": urls.OP8_SQL,
    "op9_near_dups": near_dups.OP9_SQL,
    "op10_mix": mixing.OP10_SQL,
    "op11_topk": topk.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
