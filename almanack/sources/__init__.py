"""Readers, writers and the mapping of tables to entries."""
