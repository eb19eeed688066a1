"""Training-data operators: token counts, sampling tokenisation, URL and secret filters, mixing, joins, search, sharding.

Nothing outside this subpackage imports it.
"""
