"""Operators of a training-data pipeline: dedup, packing, language, extraction, tokens, search, toxicity, quality."""
