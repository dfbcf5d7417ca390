"""Mention analytics on Spark: labels, offsets, folds, vectors and scorers for ambiguous pronouns."""
