"""Operators over corpora: lines, matches, context, listings, index, exact scanner, renderers."""
