"""Kinetra: analytics of movement records as Spark DataFrames."""
