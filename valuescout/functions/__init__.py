"""Column expressions: every one is a native Spark expression, no UDFs."""
