"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each operator module states its contract for
nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns.
"""
