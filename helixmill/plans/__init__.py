"""Registered queries: each module has queries() and oracle_sql()."""
