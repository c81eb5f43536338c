"""Operators of a training-data pipeline (language id, joins, rollups, packing,
mixing, decontamination, language models, vector dedup, quality, licenses)."""
