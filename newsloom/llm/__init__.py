"""Operators for training-data corpora: search, packing, counts, quality, duplicates, mixing,
toxicity. Nothing outside this folder imports it, save the driver contract."""
