"""Transactional analytics over streams and tables, built on DataFrames and Structured Streaming."""
