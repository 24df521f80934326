"""Readers and writers that Spark lacks."""
