"""Operators for building language-model training data at corpus scale.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library.  Each operator takes and returns DataFrames; the thin
``opN_*`` queries in :mod:`tetrad.llm.queries` bind them to the test tables.
"""
