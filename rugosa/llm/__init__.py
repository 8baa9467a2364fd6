"""Training-data operators: one module an operator, their queries in `queries`.

Nothing outside this subpackage imports it.
"""
