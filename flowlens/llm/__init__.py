"""Operators for preparing training data: near-duplicates, mixing, language, quality, packing, token counts.

Nothing else in the package imports this folder. Every operator takes and returns DataFrames, keeps an interface
of its own, and is registered through :mod:`flowlens.llm.queries`.
"""
