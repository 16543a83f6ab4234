"""Training-data operators: deduplication, decontamination, extraction, privacy, tokens and models.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
