"""Trend-signal analytics as DataFrame -> DataFrame functions on PySpark."""
