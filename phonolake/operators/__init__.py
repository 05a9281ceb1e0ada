"""Operators over tables of tokens, and kernels for what is sequential by nature."""
