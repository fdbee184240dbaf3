"""Spark jobs that build, restructure and check a large knowledge catalogue."""
