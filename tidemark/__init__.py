"""Streaming edit analytics as Spark DataFrame operators, plans and Structured Streaming jobs."""
