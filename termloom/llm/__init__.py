"""Operators for training corpora: language, language models, quality, duplicates, leaks, personal
data and packing. Nothing outside this folder, ``corpus_pipeline.py`` and the guarded part of
``__spark_entry__.py`` imports it.
"""
