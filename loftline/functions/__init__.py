"""Column functions: sub-scores, bins, text and HTML fields."""
