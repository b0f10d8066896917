"""Operators wired together into the Silver and Gold tables."""
