"""Whole jobs and the catalogue of runnable queries."""
