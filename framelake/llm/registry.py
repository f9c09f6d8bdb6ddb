"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import conversation, embedding_dedup, exact_dedup, importance, jaccard_join, language, mixing, pii, sampling, token_count, topk_search, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_token_count": token_count.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_pii": pii.query,
    "op5_toxicity": toxicity.query,
    "op6_sampling": sampling.query,
    "op7_language": language.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_topk_search": topk_search.query,
    "op10_mixing": mixing.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_importance": importance.query,
    "op13_conversation_repair": conversation.query,
}
SQL = {
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_topk_search": topk_search.SQL,
    "op10_mixing": mixing.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_importance": importance.SQL,
    "op13_conversation_repair": conversation.SQL,
}
