"""Rollout and sample analytics on PySpark DataFrames."""
