"""Readers and writers for tables, image folders, archives and label files."""
