"""Readers that turn published files into typed DataFrames."""
