"""Readers, writers and the views that shape the tables into the engine's relations."""
