"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from lexspark.llm import bpe, centroids, language_id, license_scan, license_windows, line_dedup, lm_scoring, minhash, mixing, passage_dedup, periodic_runs, quality_rules, sharding, topk, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_bpe": bpe.op4_bpe,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_top_k": topk.op8_top_k,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_minhash": minhash.op10_minhash,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_centroids": centroids.op12_centroids,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "op2_passage_dedup": passage_dedup.op2_passage_dedup,
    "op9_license_windows": license_windows.op9_license_windows,
}

#: Compression, BPE merges, learned models, hashed signatures and windows of rolling hashes have no SQL form;
#: those queries are tested against brute force.
ORACLE = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_top_k": topk.OP8_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
    "op12_centroids": centroids.OP12_SQL,
}
