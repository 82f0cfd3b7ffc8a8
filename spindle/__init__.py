"""Spindle: Spark-first condition-monitoring analytics."""
