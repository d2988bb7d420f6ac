"""Order-traffic analytics as plain functions from DataFrame to DataFrame."""
