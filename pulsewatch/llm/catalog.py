"""The registered queries of the dealt operators and their SQL, where SQL can say it."""

from pulsewatch.llm import chats, decontaminate, jaccard, neighbours, pieces, quality, ranking, secrets, sharding, substrings, suffixes, trie, warc

QUERIES = {
    "op1_chat_formatting": chats.op1_chat_formatting,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_embedding_near_dedup": neighbours.op4_embedding_near_dedup,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_ranked_search": ranking.op12_ranked_search,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op1_chat_formatting": chats.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_ranked_search": ranking.ORACLE,
    "op13_warc": warc.ORACLE,
}
