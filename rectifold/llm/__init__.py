"""Operators for language data: copies, names, canonical values, encoding, packing and language labels."""
