"""Training-data operators: extraction, formatting, tokenising, filtering and deduplication.

Nothing else in the library imports this subpackage; it can be deleted with
``corpus_pipeline.py`` and ``tests/llm`` and the rest keeps working.
"""
