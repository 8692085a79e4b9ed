"""Photovoltaic generation and weather analytics on Spark DataFrames."""
