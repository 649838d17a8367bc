"""Corpus analytics on Spark: search, ranking, identity, freshness and training-data operators."""
