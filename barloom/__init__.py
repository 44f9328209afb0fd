"""Intraday bar analytics on Spark: every operator is DataFrame -> DataFrame."""
