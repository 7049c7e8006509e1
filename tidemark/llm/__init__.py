"""Operators for training-data corpora: quality, near duplicates, URLs, sharding, mixing,
repeated passages, vector search, pseudonyms and subword encoding."""
