"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bagminhash, bpe, embeddings, licenses, mixing, pii, prefix_trie, ranking, secrets, spelling, topk, toxicity, url_filter

QUERIES = {
    "op1_secret_ledger": secrets.op1_secret_ledger,
    "op2_pii_deobfuscation": pii.op2_pii_deobfuscation,
    "op3_bagminhash_dedup": bagminhash.op3_bagminhash_dedup,
    "op4_license_tfidf": licenses.op4_license_tfidf,
    "op5_cross_polytope": embeddings.op5_cross_polytope,
    "op6_impact_topk": topk.op6_impact_topk,
    "op7_toxicity_grammar": toxicity.op7_toxicity_grammar,
    "op8_pfair_mix": mixing.op8_pfair_mix,
    "op9_bradley_terry": ranking.op9_bradley_terry,
    "op10_prefix_bpe": bpe.op10_prefix_bpe,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_bloom_urls": url_filter.op12_bloom_urls,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op1_secret_ledger": secrets.ORACLE,
    "op4_license_tfidf": licenses.ORACLE,
    "op5_cross_polytope": embeddings.ORACLE,
    "op6_impact_topk": topk.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_bloom_urls": url_filter.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
