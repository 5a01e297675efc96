"""Training-data operators: each module is one distributed operator over a documents table.

Nothing outside this subpackage imports it.
"""
