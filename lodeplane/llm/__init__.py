"""Operators of a training-data pipeline: language, extraction, tokens, mixing, quality, media, duplicates, toxicity.

Nothing outside this subpackage imports it. Each module has a general operator and its settings; `queries` holds the
thin registered queries over whole tables.
"""
