"""Batch operators that also hold for a stream of readings."""
