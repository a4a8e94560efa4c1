"""Operators for preparing training data: deduplication, decontamination, tokenising, quality, archives.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries and their SQL.
"""
