"""Relational operators over long-format tracks, samples, predictions and lane graphs."""
