"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import ann, packing, pieces, quality, secrets, sharding, simhash, substring, suffix, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_nearest": ann.op2_nearest,
    "op3_suffix_array": suffix.op3_suffix_array,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_url_filter": urls.op5_url_filter,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_substring": substring.op7_substring,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_sharding": sharding.op9_sharding,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

SQL = {
    "op2_nearest": ann.OP2_SQL,
    "op3_suffix_array": suffix.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op7_substring": substring.OP7_SQL,
}
