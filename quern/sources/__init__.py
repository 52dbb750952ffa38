"""Readers of tables and snapshots."""
