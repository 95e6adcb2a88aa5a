"""Training-data operators: quality, deduplication, decontamination, tokens, archives.

Nothing outside this subpackage imports it. ``queries`` registers one query per
operator, ``oracles`` holds the SQL where SQL can express the result.
"""
