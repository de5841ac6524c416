"""Timed-event analytics and corpus preparation on Spark DataFrames."""
