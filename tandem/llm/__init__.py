"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; its queries are in :mod:`tandem.llm.queries`.
"""
