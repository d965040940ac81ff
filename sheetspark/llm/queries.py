"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import fingerprint, jaccard, mixing, mtree, neardup, packing, pii, quality, repeats, runs, toxicity, warc

QUERIES = {
    "op1_ordinal_quality": quality.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_pii": pii.op3,
    "op4_warc_archive": warc.op4,
    "op5_vector_near_duplicates": neardup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_temperature_mixing": mixing.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_weighted_fingerprints": fingerprint.op9,
    "op10_repeated_strings": repeats.op10,
    "op11_periodic_runs": runs.op11,
    "op12_exact_top_k": mtree.op12,
}

ORACLES = {
    "op4_warc_archive": warc.OP4_SQL,
    "op5_vector_near_duplicates": neardup.OP5_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op12_exact_top_k": mtree.OP12_SQL,
}
