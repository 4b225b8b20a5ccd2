"""Readers, file discovery and writers."""
