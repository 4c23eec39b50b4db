"""Column functions: codes, geometry, projections, closed-form algebra."""
