"""Training-data operators: deduplication, language ID, scoring, packing, search, extraction.

Nothing outside this subpackage imports it; the registered queries live in
:mod:`rippletrace.llm.queries`.
"""
