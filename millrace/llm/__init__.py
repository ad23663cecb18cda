"""Training-data pipeline operators.

Self-contained: nothing else in the library imports this subpackage. Its queries and SQL
are in :mod:`millrace.llm.queries`.
"""
