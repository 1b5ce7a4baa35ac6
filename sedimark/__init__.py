"""Sedimark: evidence analytics over file collections and document tables, on Spark."""
