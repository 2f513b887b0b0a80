"""Column-level functions: safe division, missing states, aggregation specs, unit algebra."""
