"""Composed views and the registry of checked queries."""
