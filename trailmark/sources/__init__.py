"""Readers of recordings and maps into the engine's long schemas, and writers of samples."""
