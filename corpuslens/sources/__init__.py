"""Readers, writers and HTTP fetching."""
