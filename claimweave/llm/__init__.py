"""Training-data operators: ten document-scale operators and the queries that apply them.

Nothing outside this subpackage imports it.
"""
