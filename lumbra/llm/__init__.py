"""Training-data operators: deduplication, personal data, secrets, quality, mixing, packing, fingerprints, media.

Nothing outside this subpackage imports it.
"""
