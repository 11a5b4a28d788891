"""Flight-telemetry and point-cloud analytics on Spark DataFrames."""
