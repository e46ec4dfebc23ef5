"""Operators for preparing training text; nothing outside this folder and corpus_pipeline.py imports it."""
