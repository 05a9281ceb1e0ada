"""Streams: row-wise plans as they are, and running counts of words with watermarks."""
