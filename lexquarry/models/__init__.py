"""Pluggable models: embedding, reranking, answer generation, OCR.

Every model is a small object the plans take as an argument.  The defaults are
deterministic and need no files.
"""
