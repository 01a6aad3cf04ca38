"""Readers: files to tables with fixed schemas."""
