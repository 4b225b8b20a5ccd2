"""Catalog, schema versions, loads and report queries built from the operators."""
