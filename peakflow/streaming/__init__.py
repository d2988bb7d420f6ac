"""Structured Streaming pipelines built from the batch operators."""
