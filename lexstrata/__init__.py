"""Versioned document collections as Spark jobs."""
