"""Training-data operators: ten corpus-scale components and their driver queries.

Nothing outside this subpackage imports it.  ``registry`` gathers the queries.
"""
