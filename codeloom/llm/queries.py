"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from codeloom.llm import audit, chat, decontaminate, media, mixing, ngram_join, pii, quality, sharding, toxicity, trie, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_chat_format": chat.op4_chat_format,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc": warc.op7_warc,
    "op8_pii": pii.op8_pii,
    "op9_media_columns": media.op9_media_columns,
    "op10_mixing": mixing.op10_mixing,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_sharding": sharding.op12_sharding,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op4_chat_format": chat.SQL,
    "op7_warc": warc.SQL,
    "op10_mixing": mixing.sql(),
    "op11_filter_audit": audit.SQL,
    "op13_prefix_trie": trie.SQL,
}
