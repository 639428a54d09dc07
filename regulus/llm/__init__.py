"""Operators for building training corpora: one module per operator.

Nothing outside this subpackage imports it; its queries and their SQL are in
:mod:`regulus.llm.queries`.
"""
