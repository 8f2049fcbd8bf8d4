"""Queries over the star-schema tables, and the claims batch run."""
