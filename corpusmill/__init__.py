"""Corpus retrieval, selection, evaluation and data processing as PySpark plans."""

__all__ = ["runtime"]
