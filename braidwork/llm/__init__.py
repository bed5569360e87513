"""Operators for building training corpora out of large document tables.

Nothing outside this folder imports it, so the folder can be removed as a whole.
"""
