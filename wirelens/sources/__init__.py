"""Readers that turn landed files into the raw item table and the catalogs."""
