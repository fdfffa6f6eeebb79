"""Confidence-gated classification cascades on Spark."""
