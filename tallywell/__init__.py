"""Columnar event analytics on Spark: a small SQL dialect over schema-less,
append-only tables, with everything it does expressed as DataFrame operations."""
