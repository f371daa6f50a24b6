"""Retrieval, evaluation, telemetry and message operators on DataFrames."""
