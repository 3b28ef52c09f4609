"""Corpora: tables, files, byte streams; path filters and orders."""
