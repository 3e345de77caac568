"""Readers and writers: monthly text logs, CSV tables, result files."""
