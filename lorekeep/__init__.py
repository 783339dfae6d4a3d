"""Lorekeep: search, maintenance and training-data operators for document memories, on Spark."""
