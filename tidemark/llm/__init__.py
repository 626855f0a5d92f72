"""Operators for building training corpora, over any table of documents.

Nothing outside this folder imports it.
"""
