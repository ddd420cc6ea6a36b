"""Training-data operators: URL rules, packing, near-duplicates, language ID,
fingerprints, mixing, quality, HTML extraction, secret and licence scans.

Nothing outside this subpackage imports it.
"""
