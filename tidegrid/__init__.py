"""Windowed sensor-data operators on Spark DataFrames."""
