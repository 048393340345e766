"""Trace analytics on Spark: event-stream operators over DataFrames."""
