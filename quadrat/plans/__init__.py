"""Queries put together from operators: test beds, fits, summaries."""
