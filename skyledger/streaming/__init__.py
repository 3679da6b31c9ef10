"""Structured Streaming operators (H1-H7) and their batch twins."""
