"""Operators for preparing training data: splitting, pairing, redaction, parsing, provenance, encoding, packing, repetition."""
