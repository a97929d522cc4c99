"""Operators of a training-data pipeline: tokens, language, duplicates, contamination, licences, quality, packing, shards."""
