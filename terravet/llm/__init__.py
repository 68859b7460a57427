"""Operators for large training-data corpora, with their registered queries.

Nothing outside this folder imports it.  ``QUERIES`` and ``ORACLES`` hold what the
driver contract adds when the folder is there.
"""
