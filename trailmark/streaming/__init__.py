"""Metrics over streams of predictions."""
