"""Operators on libraries of files: search, learning, scoring, tags, faces and duplicates."""
