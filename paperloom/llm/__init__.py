"""Corpus preparation for language-model training: ten operators and their queries.

Nothing outside this folder and ``corpus_pipeline.py`` imports from here.
"""
