"""Per-minute summaries of network telemetry as Spark DataFrames."""
