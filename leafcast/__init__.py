"""Approximate range aggregates over maintained synopses, on Spark."""
