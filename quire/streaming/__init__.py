"""Streams of pages: segments as they come, and tables kept up to date."""
