"""Session telemetry analytics on PySpark."""
