"""Readers that turn registers, map elements, lead lists and snapshots into tables."""
