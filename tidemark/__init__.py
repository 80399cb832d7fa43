"""Spark-first market and time-keyed analytics."""
