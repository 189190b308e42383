"""Spark-native long-text retrieval: paging, embeddings, concept graph, budgeted selection."""
