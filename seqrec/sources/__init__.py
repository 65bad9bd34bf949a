"""Readers that turn files into typed DataFrames."""
