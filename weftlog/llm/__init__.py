"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this sub-package imports it; its queries are in
:mod:`weftlog.llm.queries` and are registered only where it can be imported.
"""
