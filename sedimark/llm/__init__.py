"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage.  ``queries()`` and
``oracle_sql()`` come from :mod:`sedimark.llm.registry`.
"""
