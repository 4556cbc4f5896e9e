"""Operators for preparing large training corpora, beside the document-comparison engine.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
