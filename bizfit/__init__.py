"""Spark jobs that build, match, annotate, score and search a table of companies."""
