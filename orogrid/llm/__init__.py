"""Training-data operators: dedup, formatting, mixing, packing, sharding and coding of text corpora.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` registers
the thin per-operator queries and their DuckDB counterparts.
"""
