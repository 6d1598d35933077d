"""Operators for large training corpora (dedup, quality, packing, mixing, ...).

Nothing outside this subpackage imports it; its registered queries are in
``queries.py`` and their DuckDB twins in ``oracle.py``.
"""
