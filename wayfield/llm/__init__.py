"""Training-data operators: quality, tokens, toxicity, licences, duplicates, mixing and scoring.

Nothing outside this subpackage imports it.
"""
