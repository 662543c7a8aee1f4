"""Pipelines built from the operators."""
