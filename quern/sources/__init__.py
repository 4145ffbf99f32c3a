"""Readers: tables of a data folder, files, and views that give relational tables the report model's shape."""
