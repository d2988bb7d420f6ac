"""DataFrame operators: quality, latest state, demand, pressure, dashboards."""
