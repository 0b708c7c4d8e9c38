"""The query language: registry, validation, planning, sessions and answers."""
