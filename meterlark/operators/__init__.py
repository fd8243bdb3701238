"""Operators over telemetry DataFrames."""
