"""Readers that bring telemetry and prices into typed DataFrames."""
