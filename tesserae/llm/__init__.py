"""Operators that prepare training text: archives, licences, tokens, quality,
fingerprints, decontamination, secrets, near-duplicates and toxicity.

Nothing outside this subpackage imports it.
"""
