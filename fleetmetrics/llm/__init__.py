"""Training-data operators: deduplication, mixing, scans, models, tokens, vectors.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
