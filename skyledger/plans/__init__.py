"""Composed jobs (telemetry, carts) and the registry of named queries."""
