"""Readers and writers through Spark's data sources (IO1-IO11)."""
