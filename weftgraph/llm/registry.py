"""The subpackage's queries and their SQL, as __spark_entry__ offers them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, minhash, partenum, prefix_trie, quality, sort_means, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_chat_format": chat.op4_chat_format,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc_zstd": warc.op8_warc_zstd,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_language_id": langid.op10_language_id,
    "op11_sort_means": sort_means.op11_sort_means,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_partenum_join": partenum.op13_partenum_join,
}

ORACLES: dict[str, str] = {
    "op4_chat_format": chat.OP4_SQL,
    "op11_sort_means": sort_means.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_partenum_join": partenum.OP13_SQL,
}
