"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import byte_cnn, fingerprints, mixing, packing, quality_rules, secrets, simhash, suffix_arrays, toxicity, url_filters

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_byte_cnn": byte_cnn.op2_byte_cnn,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_url_rules": url_filters.op6_url_rules,
    "op7_packing": packing.op7_packing,
    "op8_simhash": simhash.op8_simhash,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_suffix_arrays": suffix_arrays.op10_suffix_arrays,
}
ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE,
}
