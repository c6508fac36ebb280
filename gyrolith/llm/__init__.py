"""Operators of a training-data pipeline over a table of documents, pages or embeddings.

Nothing else in the library imports this subpackage.
"""
