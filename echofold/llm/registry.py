"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, divergence, extraction, fingerprints, language, lm_score, pieces, sharding, simhash, toxicity, trie, warc

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_chat_format": chat.op2_chat_format,
    "op3_revisits": warc.op3_revisits,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_fingerprint": fingerprints.op5_fingerprint,
    "op6_simhash": simhash.op6_simhash,
    "op7_pieces": pieces.op7_pieces,
    "op8_language": language.op8_language,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_sharding": sharding.op10_sharding,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_extraction": extraction.op12_extraction,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op3_revisits": warc.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
