"""Structured Streaming form of the resumable run."""
