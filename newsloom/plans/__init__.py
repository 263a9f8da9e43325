"""Whole jobs: each takes tables and gives tables, lazily."""
