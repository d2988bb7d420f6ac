"""Tables and files the results are written to."""
