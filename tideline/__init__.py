"""tideline: partitioned append-only logs as Spark tables."""
