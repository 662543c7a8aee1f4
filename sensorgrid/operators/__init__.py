"""Operators on DataFrames: windows, panels, interpolation, features, geometry, models."""
