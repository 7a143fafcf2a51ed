"""Operators for large text corpora (training-data preparation).

Nothing outside this folder imports it; see ``queries.py`` for the driver's queries.
"""
