"""Telemetry, cost, quota and text-quality analytics as Spark DataFrames."""
