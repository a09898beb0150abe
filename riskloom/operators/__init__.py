"""DataFrame operators: counts, grids, priors, roll-ups, learning, forecasts."""
