"""Training-data operators over page, chunk and document tables.

Nothing outside this subpackage imports it; the package works without it.
"""
