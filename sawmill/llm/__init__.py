"""Operators for large-scale training-data preparation (documents, embeddings, shards)."""
