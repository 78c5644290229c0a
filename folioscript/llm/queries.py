"""The package's registered queries: name -> (query, SQL twin or None)."""

from __future__ import annotations

from folioscript.llm import decontamination, embedding_dedup, fingerprints, html_extract, line_dedup, periodic_runs, prefix_trie, sentencepiece_bpe, sharding, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_decontamination": (decontamination.op1_decontamination, None),
    "op2_sentencepiece": (sentencepiece_bpe.op2_sentencepiece, None),
    "op3_line_dedup": (line_dedup.op3_line_dedup, None),
    "op4_sharding": (sharding.op4_sharding, None),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_simhash": (simhash.op6_simhash, None),
    "op7_warc": (warc.op7_warc, warc.SQL),
    "op8_token_counts": (token_counts.op8_token_counts, None),
    "op9_html_extract": (html_extract.op9_html_extract, None),
    "op10_embedding_dedup": (embedding_dedup.op10_embedding_dedup, embedding_dedup.SQL),
    "op11_periodic_runs": (periodic_runs.op11_periodic_runs, None),
    "op12_fingerprints": (fingerprints.op12_fingerprints, fingerprints.SQL),
    "op13_prefix_trie": (prefix_trie.op13_prefix_trie, prefix_trie.SQL),
}
