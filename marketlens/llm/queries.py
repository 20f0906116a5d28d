"""The queries of the text operators, and their SQL where SQL can express them."""

from . import bpe, fingerprints, licenses, neardup, packing, passages, quality, secrets, sharding, spelling, toxicity, trie, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_packing": packing.op5_packing,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_bpe": bpe.op7_bpe,
    "op8_substring_dedup": passages.op8_substring_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_near_dedup": neardup.op10_near_dedup,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_license_scans": licenses.op12_license_scans,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op6_fingerprints": fingerprints.OP6_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_near_dedup": neardup.OP10_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
