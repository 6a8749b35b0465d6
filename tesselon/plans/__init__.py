"""Registered queries: the operators applied to the driver's tables, each beside its DuckDB equivalent."""
