"""Load-test latency analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
