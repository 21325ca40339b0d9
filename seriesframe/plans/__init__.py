"""Catch, abundance and timing pipelines composed from the operators."""
