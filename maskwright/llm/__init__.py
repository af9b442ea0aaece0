"""Training-data operators: deduplication, decontamination, scans, tokens.

Nothing outside this subpackage imports it.
"""
