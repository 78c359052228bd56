"""Training-data operators: quality rules, mixing, dedup, scans, tokenizers, language model, binary output.

Nothing else in the library imports this subpackage.
"""
