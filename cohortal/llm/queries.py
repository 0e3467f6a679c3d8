"""Queries of the numbered operators, and SQL for those that it can express."""

from cohortal.llm import decontaminate, importance, language, minhash, mixing, negatives, secret_scan, sharding, substrings, tokens, topk, toxicity, url_filter

QUERIES = {
    "op1_sharding": sharding.shard_documents,
    "op2_substring_dedup": substrings.substring_documents,
    "op3_topk": topk.nearest_vectors,
    "op4_url_filter": url_filter.filter_pages,
    "op5_mixing": mixing.mix_documents,
    "op6_near_dedup": minhash.near_documents,
    "op7_tokens": tokens.token_documents,
    "op8_language": language.language_documents,
    "op9_decontamination": decontaminate.leaked_documents,
    "op10_secrets": secret_scan.secret_documents,
    "op11_importance": importance.importance_documents,
    "op12_negatives": negatives.mined_embeddings,
    "op13_toxicity": toxicity.toxic_documents,
}

SQL = {"op1_sharding": sharding.SQL, "op3_topk": topk.SQL, "op11_importance": importance.SQL, "op12_negatives": negatives.SQL}
