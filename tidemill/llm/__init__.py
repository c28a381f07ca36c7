"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator has a general
interface in its own module; :mod:`tidemill.llm.queries` derives the registered
queries from them.
"""
