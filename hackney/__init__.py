"""Taxi-trip analytics on Spark: raw text to typed trips, a star schema, quality checks and metrics."""
