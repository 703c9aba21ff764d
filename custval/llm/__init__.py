"""Operators for large training-data pipelines (see the README section of the same name).

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
