"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`quillgraph.llm.queries` derives the
registered ``opN_*`` queries from them.
"""
