"""Lodestone: corpus, similarity-graph and retrieval analytics expressed as Spark plans."""
