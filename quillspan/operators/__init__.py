"""Operators on interval, frame, sequence, signal and feature tables: DataFrames in, DataFrames out."""
