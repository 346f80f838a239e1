"""Training-data operators.  Nothing else in the library imports this subpackage.

Each operator module has a general DataFrame interface; the thin queries that
apply them to the driver tables live in ``promptspread.llm.queries``.
"""
