"""Registered queries: a name, a function of (spark, sf_dir), and the same in SQL where SQL can express it."""
