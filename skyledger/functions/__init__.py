"""Column expressions: geometry, decoding, flags."""
