"""Windowed stream analytics on PySpark."""
