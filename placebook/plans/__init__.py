"""Whole runs: folder to directory, and request to directory."""
