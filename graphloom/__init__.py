"""Spark-first analytics over typed graphs, report texts and embeddings."""
