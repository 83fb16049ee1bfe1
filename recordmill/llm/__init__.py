"""Training-data operators: ten corpus operators, each a module of this package.

Nothing outside this package imports it; ``queries.QUERIES`` and ``queries.ORACLE_SQL``
are picked up by the entry module when the package is present.
"""
