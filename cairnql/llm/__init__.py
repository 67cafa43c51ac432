"""Training-data operators: sharding, dedup, mixing, packing, scoring, search, counting, redaction.

Nothing outside this subpackage imports it.  Each operator module holds the general
operator; ``queries`` registers the thin ``opN_<name>`` digests over the driver tables.
"""
