"""Driver-side planning: which rows a search has to look at."""
