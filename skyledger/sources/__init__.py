"""Readers (A1-A4), sinks (A5, A6) and views over the driver tables."""
