"""Operators for training-data pipelines: filters, joins, deduplication, language models, mixing."""
