"""Incremental runs over folders that keep receiving pages."""
