"""Column expressions: calendar, numeric and gamma-distribution functions."""
