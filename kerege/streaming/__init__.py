"""Documents that arrive over time."""
