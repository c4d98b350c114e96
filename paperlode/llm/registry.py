"""Queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from paperlode.llm import bpe, exact_dedup, jaccard_join, language_id, mixing, sharding, suffix_dedup, toxicity, warc, winnowing

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_language_id": language_id.op3_language_id,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_winnowing_fingerprints": winnowing.op5_winnowing_fingerprints,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op7_link_counts": jaccard_join.op7_link_counts,
    "op8_shard_documents": sharding.op8_shard_documents,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op6_warc_round_trip": warc.OP6_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op7_link_counts": jaccard_join.OP7_LINKS_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
