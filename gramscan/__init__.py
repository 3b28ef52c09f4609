"""Indexed regular-expression search and corpus processing on Spark."""
