"""Readers and adapters that produce order events."""
