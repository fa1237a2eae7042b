"""End-to-end plans built from operators and column functions."""
