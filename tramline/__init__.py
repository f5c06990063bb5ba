"""Transit-telemetry analytics as Spark DataFrame, Structured Streaming and Spark ML code."""
