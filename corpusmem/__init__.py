"""Corpus jobs on Spark: incremental indexing, ranked retrieval with citations, and note keeping, over tables."""
