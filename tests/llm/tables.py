"""The table that each query answers row by row."""

COUNTS = {
    "op1_decontamination": "documents", "op2_sentencepiece": "documents", "op3_token_counts": "documents", "op4_embedding_dedup": "embeddings", "op5_pii": "documents",
    "op6_jaccard_join": "documents", "op7_url_filters": "pages", "op8_quotations": "conversations", "op9_language_id": "documents", "op10_toxicity": "documents", "op12_fingerprints": "documents",
}
