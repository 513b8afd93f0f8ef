"""Operators for preparing training corpora.

Each module holds one operator with its own general interface; ``queries``
binds them to the given tables and ``oracle`` holds the DuckDB SQL of those
that SQL can express.  Nothing outside this subpackage imports it.
"""
