"""Training-data operators (dedup, packing, tokens, quality, language, search).

Nothing else in the library imports this subpackage.
"""
