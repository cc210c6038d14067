"""Incremental pick-up of new files."""
