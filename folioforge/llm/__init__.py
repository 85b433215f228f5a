"""Training-data operators: search, privacy, deduplication, mixing, packing, token files, licences, language.

Nothing outside this subpackage imports it.
"""
