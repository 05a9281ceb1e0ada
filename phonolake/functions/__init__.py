"""Scalar functions over text, phonemes and numbers."""
