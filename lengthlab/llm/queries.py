"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lengthlab.llm import (
    bpe,
    jaccard_join,
    licenses,
    multi_index,
    packing,
    periodic_runs,
    phrases,
    pii,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_multi_index": multi_index.op2_multi_index,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_packing": packing.op5_packing,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_licenses": licenses.op10_licenses,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_phrases": phrases.op12_phrases,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op9_quality": quality.oracle_sql(),
}
