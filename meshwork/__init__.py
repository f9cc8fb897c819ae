"""Property-graph analytics expressed as Spark DataFrame and SQL plans."""
