"""Reasoning over uncertain, time-stamped and conflicting facts, compiled to Spark DataFrames."""
