"""Whole jobs and the queries over the driver's tables."""
