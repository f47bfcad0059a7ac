"""Operators of a training-data pipeline over text documents.

Nothing outside this subpackage imports it; ``queries.py`` holds the query registry.
"""
