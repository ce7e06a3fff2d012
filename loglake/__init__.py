"""loglake: partitioned append-only logs as DataFrames. See README.md."""
